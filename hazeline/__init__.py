"""Smoke-event analytics on Spark, declared with the DataFrame and SQL API."""
