"""Streaming of the transliteration library."""
