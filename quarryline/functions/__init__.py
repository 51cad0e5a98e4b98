"""quarryline functions."""
