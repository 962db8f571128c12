"""Structured Streaming versions of preparation and run totals."""
