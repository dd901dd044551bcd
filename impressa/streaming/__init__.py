"""Structured Streaming form of the resumable chunk conversion (K3)."""
