"""Queries over the standard tables, built from the library's operators."""
