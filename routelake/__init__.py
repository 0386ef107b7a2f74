"""A PySpark engine for hiking networks."""
