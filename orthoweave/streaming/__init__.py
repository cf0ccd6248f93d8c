"""Analyses over streams of texts."""
