"""fleetline: device-fleet telemetry operators on Spark.

Every public operator is a lazy function DataFrame -> DataFrame built from
Spark SQL expressions, so the same logic runs as a batch job or inside a
Structured Streaming ``foreachBatch``.  Time never comes from the wall clock:
callers pass an explicit ``as_of``.
"""

__all__ = ["session", "schemas"]
