"""Readers, writers and the transaction view built from the given tables."""
