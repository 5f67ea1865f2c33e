"""Relational operators over edge, vertex, rank and routing tables."""
