"""Composed queries over the engine's operators."""
