"""Whole analyses, and the registry of queries with their SQL."""
