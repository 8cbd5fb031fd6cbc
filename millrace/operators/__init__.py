"""DataFrame operators and fitted steps."""
