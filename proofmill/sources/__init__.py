"""Readers: source trees, produced corpora, case notes, and code derived from the star tables."""
