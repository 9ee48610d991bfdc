"""DataFrame operators built from the column functions."""
