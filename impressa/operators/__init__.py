"""impressa.operators."""
