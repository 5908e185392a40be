"""Column functions over text, tokens and paths."""
