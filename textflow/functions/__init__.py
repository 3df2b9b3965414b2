"""Functions of the text-difficulty engine."""
