"""gridloom: a PySpark-native engine for exploring and transforming delimited data."""
