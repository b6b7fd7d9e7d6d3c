"""Whole queries: file scan, reports, portfolio statistics."""
