"""Batches and cursors on storage."""
