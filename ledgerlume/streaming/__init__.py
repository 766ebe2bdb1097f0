"""Operators over streams of transfers."""
