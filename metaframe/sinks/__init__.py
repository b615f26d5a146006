"""Writers of project XML, records XML, CSV and spreadsheets."""
