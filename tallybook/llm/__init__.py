"""Operators on records and texts for training data; nothing outside imports this package."""
