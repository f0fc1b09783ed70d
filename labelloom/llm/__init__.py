"""Operators for preparing training text at scale; nothing else of the library imports this package."""
