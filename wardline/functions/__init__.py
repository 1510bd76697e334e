"""Subpackage of wardline."""
