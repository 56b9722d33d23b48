"""Longitudinal health-record analytics on Spark DataFrames."""
