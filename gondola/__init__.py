"""Retail-price jobs on Spark: plain functions from DataFrames to DataFrames."""
