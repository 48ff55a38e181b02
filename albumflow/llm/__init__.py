"""Operators for preparing language-model training text.  Nothing outside imports this."""
