"""Operators: functions from DataFrames to DataFrames that run nothing themselves."""
