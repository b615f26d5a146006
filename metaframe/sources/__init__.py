"""Readers of project XML, generic XML, spreadsheets and files."""
