"""Structured Streaming: chunk compression, running consolidation, event-time windows."""
