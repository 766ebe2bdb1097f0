"""Registered queries, each with an equivalent in SQL."""
