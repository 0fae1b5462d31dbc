"""setweave plans."""
