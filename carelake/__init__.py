"""carelake: clinic document and patient-outreach analytics on Spark.

Every operator takes and returns DataFrames (or Columns) and is expressed with
built-in Spark SQL functions so Catalyst can prune, push down and codegen it.
"""

__version__ = "0.1.0"
