"""Operators for building training data at cluster scale. Nothing else in the library imports this package."""
