"""Operators: functions from DataFrames to DataFrames over relations of the shape (series, t, value..., weight)."""
