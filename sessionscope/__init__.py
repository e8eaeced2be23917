"""Product-analytics operators over a session fact table, on Spark.

Every operator takes a sessions ``DataFrame`` plus keyword parameters and
returns a lazy ``DataFrame``.
"""
