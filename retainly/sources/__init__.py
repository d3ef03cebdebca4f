from .tables import TABLES, load_table, register_tables, read_csv  # noqa: F401
