"""Queries over the driver's tables, each built from the operators of this package."""
