"""Operators: functions from DataFrames to a DataFrame, lazy, without global state."""
