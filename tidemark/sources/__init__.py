"""Readers and synthetic sources."""
