"""Log engine: plans."""
