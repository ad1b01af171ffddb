"""Operators for building large training corpora on Spark.

Self-contained: nothing outside this subpackage imports it.
"""
