"""Relational operators over event tables and sparse frames."""
