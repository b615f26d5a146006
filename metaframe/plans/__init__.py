"""Schemas compiled to column expressions."""
