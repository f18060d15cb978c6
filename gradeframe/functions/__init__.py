"""Column functions: every one maps columns to a column, row by row."""
