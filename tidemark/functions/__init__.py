"""Column functions: built-in expressions only, except the fuzzy text ratio."""
