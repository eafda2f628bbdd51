"""Building blocks: SQL expressions over columns, and joins on reference columns."""
