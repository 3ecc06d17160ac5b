"""Functions over rows and columns."""
