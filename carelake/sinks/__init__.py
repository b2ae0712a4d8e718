"""Writers: the Parquet lake, the ``uploads`` catalog table and keyed upserts."""
