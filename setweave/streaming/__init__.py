"""setweave streaming."""
