"""Incremental products over newly arrived points."""
