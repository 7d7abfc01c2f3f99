"""Readers and normalisers of market data."""
