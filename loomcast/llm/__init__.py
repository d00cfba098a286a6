"""Operators on texts for training-data preparation; nothing else in this package imports them."""
