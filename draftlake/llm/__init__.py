"""Operators that prepare text, media and vectors for model training."""
