"""Structured Streaming variants of the resampling operators."""
