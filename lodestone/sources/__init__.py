"""Readers: exports, APIs, pages, run history."""
