"""Lipika: corpus-scale Indic transliteration and lexicon jobs on Spark DataFrames."""
