"""Operators: functions from DataFrames to DataFrames, never collecting."""
