"""Whole flows composed of operators, and the tables they run on."""
