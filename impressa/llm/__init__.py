"""Operators for preparing language-model training data (see README.md, "llm")."""
