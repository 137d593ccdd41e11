"""Coloured k-mer graph analytics on Spark DataFrames."""
