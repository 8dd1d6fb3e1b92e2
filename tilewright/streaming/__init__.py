"""Incremental processing of newly arrived sample files."""
