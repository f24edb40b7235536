"""Training-data operators for very large text corpora, all on Spark DataFrames.

Nothing outside this subpackage imports it.
"""
