"""setweave sources."""
