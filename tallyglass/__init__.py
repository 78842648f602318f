"""Warehouse and stream analytics operators on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame, built from
built-in Spark expressions.  ``operators`` holds the batch operators,
``streaming`` the Structured Streaming ones, ``sources`` the readers and
writers, ``functions`` the shared column expressions and skew helpers, and
``plans`` the period drivers and the registered queries.
"""
