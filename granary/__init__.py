"""granary: relational analytics on PySpark DataFrames."""
