"""Operators of the transliteration library."""
