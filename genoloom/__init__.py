"""Genomic variant search over position ranges, expressed as Spark DataFrames."""
