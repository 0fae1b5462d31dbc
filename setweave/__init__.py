"""setweave: token-set, activation and evaluation analytics as plain Spark DataFrame functions."""
