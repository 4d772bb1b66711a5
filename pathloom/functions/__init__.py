"""Column functions for DNA, path names and positions."""
