"""Structured Streaming forms of the pending read and the manifest."""
