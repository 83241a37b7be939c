"""Operators of the panel library."""
