"""Readers: parquet tables, raw export lines, whole export files."""
