"""quarryline sources."""
