"""Column functions for text and vectors, and the models that callers plug in."""
