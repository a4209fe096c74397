"""Operators that a training-data pipeline needs, one module each; nothing else in the library imports them."""
