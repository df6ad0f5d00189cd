"""Operators for preparing training text: filtering, deduplication, scoring, encoding."""
