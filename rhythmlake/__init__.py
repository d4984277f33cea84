"""Behavioural pattern analytics on PySpark: DataFrame in, DataFrame out."""
