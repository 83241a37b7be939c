"""Plans of the panel library."""
