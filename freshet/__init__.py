"""Freshness-aware incremental processing of dated batches on Spark."""
