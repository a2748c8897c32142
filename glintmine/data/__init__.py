"""Corpora that come with the package, as data files."""
