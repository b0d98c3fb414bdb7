"""Operators for training text and records; nothing outside this package imports it."""
