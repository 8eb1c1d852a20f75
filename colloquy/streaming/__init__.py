"""Structured Streaming counterparts of the stateless steps."""
