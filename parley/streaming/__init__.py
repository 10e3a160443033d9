"""Structured Streaming jobs of live conversations."""
