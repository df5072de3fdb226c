"""Structured Streaming: ingest, live rollups, live snapshots, change detection."""
