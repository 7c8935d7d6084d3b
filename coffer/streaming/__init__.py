"""Structured Streaming jobs over price payload landing directories."""
