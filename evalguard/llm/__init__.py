"""Operators of a training-data pipeline, one module each, built on Spark.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
