"""impressa.plans."""
