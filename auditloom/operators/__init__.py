"""Relational operators of the audit."""
