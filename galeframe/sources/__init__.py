"""Readers and writers that bring every input to one normalised schema."""
