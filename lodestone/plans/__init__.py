"""Whole dataflows and their command line."""
