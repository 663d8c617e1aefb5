"""sanscope: certificate-transparency domain analytics on Spark.

Every operator is a DataFrame transformation built from built-in
``pyspark.sql.functions``; nothing here runs per-row Python.
"""

__all__ = ["session", "constants"]
