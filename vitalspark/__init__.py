"""Performance-diagnostics analytics on PySpark DataFrames."""
