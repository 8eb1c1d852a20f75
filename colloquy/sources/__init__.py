"""Readers and writers for prompt data."""
