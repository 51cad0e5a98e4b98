"""quarryline plans."""
