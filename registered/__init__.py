"""Queries over the given tables, each with its SQL for another engine where that exists."""
