"""Functions of the panel library."""
