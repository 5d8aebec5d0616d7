"""Operators that prepare text corpora."""
