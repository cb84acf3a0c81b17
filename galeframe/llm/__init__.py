"""Operators for preparing training data: filters, deduplication, scans, models and tokenization.

Nothing else in the library imports this subpackage.
"""
