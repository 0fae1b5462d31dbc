"""setweave operators."""
