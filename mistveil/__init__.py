"""Sensitive-data detection and redaction over Spark DataFrames."""
