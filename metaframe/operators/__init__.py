"""Operators on record, field and relation tables."""
