"""Scalar functions as Column expressions; the few that need Python are Arrow-batched."""
