"""Operators for preparing training data from event sequences and texts. Nothing outside imports this."""
