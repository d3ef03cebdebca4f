"""retainly: Spark-native churn and tabular-ML analytics operators.

Every operator is a pure ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, so Catalyst can prune, push down and plan it.
"""

__version__ = "0.1.0"
