"""impressa.functions."""
