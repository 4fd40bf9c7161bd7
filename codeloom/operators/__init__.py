"""Operators over the model's tables, by family."""
