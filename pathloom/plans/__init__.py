"""Session, scratch-table and iteration helpers that several operators share."""
