"""Audience building and analysis on Spark DataFrames."""
