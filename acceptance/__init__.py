"""Queries over the given tables that exercise every operator, with their SQL oracles."""
