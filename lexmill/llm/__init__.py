"""Operators for language-model text corpora. Nothing else in the library imports this package."""
