"""Operators for preparing language-model training corpora on Spark.

Nothing outside this subpackage imports it.
"""
