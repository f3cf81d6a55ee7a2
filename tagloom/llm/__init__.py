"""Operators for training-data pipelines over text and embeddings.

Every operator takes DataFrames and returns DataFrames.  Nothing outside this
subpackage imports it.
"""
