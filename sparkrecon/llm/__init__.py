"""Operators for preparing training text, each run by one registered query."""
