"""Functions of the transliteration library."""
