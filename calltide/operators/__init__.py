"""Relational operators over traces."""
