"""Structured Streaming forms of the event queries: windows, sessions, late data, state."""
