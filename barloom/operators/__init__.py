"""Operators on bar, label, fold and prediction tables."""
