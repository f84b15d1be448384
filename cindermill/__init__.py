"""Cindermill: a log-intelligence engine on PySpark DataFrames, Spark SQL and Structured Streaming."""
