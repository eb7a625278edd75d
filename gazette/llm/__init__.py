"""Operators that prepare announcement text for language-model training.  Nothing outside imports this package."""
