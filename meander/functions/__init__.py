"""Column expressions and skew-proof building blocks the operators share."""
