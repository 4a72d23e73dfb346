"""Operators: functions from DataFrames to DataFrames over edge, item and token tables."""
