"""Training-data operators on Spark.

Nothing outside this package imports it.  ``queries.QUERIES`` and
``queries.ORACLES`` are what the driver entry adds when it can be imported.
"""
