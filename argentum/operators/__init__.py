"""Relational and vector operators over library tables."""
