"""Composed analyses (marts) and the registered driver queries."""
