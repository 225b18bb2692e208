"""Column expressions. All of them stay inside Catalyst; there is no UDF."""
