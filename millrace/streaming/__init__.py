"""Structured Streaming jobs: scoring, rollups and the quality gate."""
