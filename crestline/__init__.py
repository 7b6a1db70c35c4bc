"""Distributed top-k analytics on Spark DataFrames."""
