"""quarryline streaming."""
