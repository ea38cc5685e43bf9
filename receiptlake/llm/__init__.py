"""Operators for text corpora used in training; nothing else in the library imports them."""
