"""Operators: functions from DataFrames to DataFrames. The current time is always a parameter."""
