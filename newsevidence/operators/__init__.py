"""Operators: functions from DataFrames to DataFrames, lazily composed."""
