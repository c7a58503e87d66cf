"""Layered memory analytics on Spark DataFrames."""
