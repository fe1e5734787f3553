"""Queries: the operators over the tables in a folder."""
