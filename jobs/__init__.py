"""Runnable jobs over the library: ``python -m jobs.NAME --config FILE``."""
