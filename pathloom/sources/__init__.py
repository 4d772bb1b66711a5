"""Readers and writers: graph files, side inputs, and graphs over relational tables."""
