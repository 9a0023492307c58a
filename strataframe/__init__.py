"""Selective scans, skip indexes, logical encodings and change logs over columnar tables, built on Spark DataFrames."""
