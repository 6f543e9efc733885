"""Batch runners."""
