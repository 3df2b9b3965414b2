"""Streaming of the text-difficulty engine."""
