"""Operators on cell tables: row, col, and a value column such as z or fdr."""
