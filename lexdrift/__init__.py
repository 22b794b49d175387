"""Lexdrift: semantic-drift analytics over large text corpora, as lazy PySpark DataFrame transformations."""
