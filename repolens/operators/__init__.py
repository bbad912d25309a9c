"""Relational and graph operators over the code tables."""
