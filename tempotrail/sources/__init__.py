"""Readers and writers of result pages, tables, JSON and tracks."""
