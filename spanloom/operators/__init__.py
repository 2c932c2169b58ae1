"""Operators over annotation tables."""
