"""Payments and funnel analytics on PySpark.

Every operator takes DataFrames and returns one DataFrame. Nothing here runs an
action: plans stay lazy until the caller writes or collects them.
"""
