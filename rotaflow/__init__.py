"""Fleet telemetry analytics on Spark DataFrames.

Every operator takes and returns DataFrames that hold all machines at once,
keyed by ``well_id``; nothing loops over machines.
"""

__version__ = "0.1.0"
