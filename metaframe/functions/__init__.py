"""Column functions: text, checks and coercion."""
