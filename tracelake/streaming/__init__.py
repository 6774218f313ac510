"""Structured Streaming over folders to which trace files are added."""
