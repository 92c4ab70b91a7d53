"""Incremental indexing as a stream of files."""
