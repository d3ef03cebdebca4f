"""Shared column-level helpers (statistics, checks, stable hashing, ranking)."""
