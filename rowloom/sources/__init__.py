"""Where tables come from and where their versions are kept."""
