"""Relational operators over long and array-valued feature tables."""
