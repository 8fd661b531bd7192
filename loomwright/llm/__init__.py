"""Operators for building training corpora: deduplication, decontamination, filtering, tokenising, scoring.

Nothing else in the library imports this subpackage.
"""
