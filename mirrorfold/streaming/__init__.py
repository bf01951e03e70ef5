"""Structured Streaming: the change log applied continuously."""
