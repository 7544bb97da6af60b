"""Log engine: sources."""
