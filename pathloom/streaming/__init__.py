"""Incremental reports over streams of arriving rows (an extension; the graph tools are batch)."""
