"""Plans of the transliteration library."""
