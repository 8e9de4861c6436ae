"""Column builders: everything here maps columns to a column."""
