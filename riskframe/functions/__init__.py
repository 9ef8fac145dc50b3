"""Column helpers: features, fixed lookup values, numeric rounding."""
