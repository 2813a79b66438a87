"""Audit a website migration over captured tables, as DataFrame jobs."""
