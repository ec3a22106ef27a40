"""Distributed collections expressed as Spark DataFrames."""
