"""Cleaning, anomaly scoring and forecasting of event time series on Spark.

Every operator is a function from DataFrame to DataFrame.  See README.md for
the module map.
"""
