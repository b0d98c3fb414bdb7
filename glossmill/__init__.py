"""glossmill: a PySpark-native engine for item-level text tables.

Every operator is a function from DataFrames to a DataFrame; plans stay lazy and
JVM-side unless a docstring says otherwise.
"""
