"""Readers of spreadsheets and of HTML tables: bytes or text in, rows of cells out."""
