"""Operators for preparing training corpora, their queries and SQL."""
