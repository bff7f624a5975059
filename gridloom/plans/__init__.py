"""How rows get their places: ordinals of tables and split points of files."""
