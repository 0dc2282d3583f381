"""Alignment and analysis of time-ordered feature sequences on Spark DataFrames."""
