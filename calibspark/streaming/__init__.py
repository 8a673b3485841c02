"""Structured Streaming forms of the corpus filters, quota and head
sampling, and result ingest (T1-T4)."""
