"""Readers: site tables, boundaries, configurations."""
