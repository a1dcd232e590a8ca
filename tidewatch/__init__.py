"""Interval and time-series analytics over telemetry, on Spark DataFrames."""
