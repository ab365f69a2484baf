"""Readers and writers for the file shapes the pipeline consumes and produces."""
