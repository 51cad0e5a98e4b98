"""quarryline operators."""
