"""Relational building blocks: selection, detectors, repository joins, ranking."""
