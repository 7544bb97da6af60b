"""Log engine: operators."""
