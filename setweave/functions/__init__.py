"""setweave functions."""
