"""Column expressions: coercion, category text, and row-level features."""
