"""Structured Streaming forms of the sync worker: its queue, the states of its events, and the scan for changed files."""
