"""Operators on corpora of text. Nothing else in the library imports this subpackage."""
