"""Graphs from tables, source trees, coverage reports."""
