"""Query plans over the driver's tables: each registered query is a function
``(spark, sf_dir) -> DataFrame`` paired with an independent SQL oracle."""
