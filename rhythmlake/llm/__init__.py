"""Operators on token, pattern and text corpora; nothing outside this subpackage imports it."""
