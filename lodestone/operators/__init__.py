"""Relational operators over prompts, metrics, pages and runs."""
