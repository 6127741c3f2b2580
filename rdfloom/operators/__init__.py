"""Operators on solutions."""
