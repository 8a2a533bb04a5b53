"""Job-matching analytics on PySpark: sources, text functions, operators, plans and streams."""
