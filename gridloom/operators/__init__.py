"""Operators over sheets' rows: DataFrames with ``row`` and ``fields``."""
