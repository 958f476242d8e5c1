"""Corpus operators for large training sets: packing, formatting, scoring, deduplication, tokens.

Nothing else in the library imports this subpackage.
"""
