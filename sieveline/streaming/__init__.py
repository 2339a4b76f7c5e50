"""Continuous ingestion into stored fields."""
