"""Whole plans: from a raw table to conformed rows, issues and summaries."""
