"""Readers of landed data and writers of registry tables."""
