"""Operators for preparing training text, each usable on any DataFrame with ``doc_id`` and ``text``.

Nothing else in the library imports this subpackage.
"""
