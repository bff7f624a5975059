"""Delimited files: grammar, dialect, distributed reading, guarded writing, generated fixtures."""
