"""Plans of the text-difficulty engine."""
