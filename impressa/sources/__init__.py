"""impressa.sources."""
