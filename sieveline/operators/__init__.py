"""Filters, sorts, searches: pure functions from entries to DataFrames."""
