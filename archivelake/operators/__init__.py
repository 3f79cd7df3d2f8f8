"""Operators on the table of contents."""
