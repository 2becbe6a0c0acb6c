"""Readers and writers.  Every reader gives a DataFrame with a stated schema."""
