"""Relational operators over token, vote, pool and gold tables."""
