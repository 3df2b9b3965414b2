"""Sources of the text-difficulty engine."""
