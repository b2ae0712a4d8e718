"""Scans over uploaded files and the Parquet lake."""
