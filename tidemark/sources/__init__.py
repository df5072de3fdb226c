"""Batch and stream readers, batch sinks."""
