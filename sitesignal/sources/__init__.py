"""Readers and writers: signal JSON lines, label CSV, reads Parquet."""
