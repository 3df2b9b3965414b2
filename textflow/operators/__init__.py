"""Operators of the text-difficulty engine."""
