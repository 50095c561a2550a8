"""Composed plans: fixture views, registered queries and their SQL oracle."""
