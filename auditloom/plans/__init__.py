"""Whole plans: audit, documents, charts and the driver queries."""
