"""spanlab: a PySpark engine for span-annotated text."""
