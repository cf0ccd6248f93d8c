"""Readers and writers of lexicons, word lists and texts."""
