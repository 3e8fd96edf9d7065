"""Incremental ingestion of newly arriving daily files with Structured Streaming."""
