"""Stratoloom: spatial multi-omics analytics on Spark DataFrames."""
