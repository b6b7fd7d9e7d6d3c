"""Readers and writers for archives, trees, repository lists and reports."""
