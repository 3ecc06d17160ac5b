"""Streams that end in a table."""
