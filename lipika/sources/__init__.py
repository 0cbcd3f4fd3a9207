"""Sources of the transliteration library."""
