"""Training-corpus operators. Nothing outside this package imports it."""
