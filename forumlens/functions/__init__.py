"""Column expressions: everything here maps columns to a column and stays inside codegen."""
