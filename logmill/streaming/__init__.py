"""Log engine: streaming."""
