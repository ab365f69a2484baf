"""Operators for training-data pipelines. Nothing outside this subpackage (and the entry module) imports it."""
