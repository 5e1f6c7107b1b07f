"""Column -> Column rules. Nothing here needs a Python UDF except the t distribution."""
