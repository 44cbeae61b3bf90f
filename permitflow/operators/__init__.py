"""Relational operators over permit records."""
