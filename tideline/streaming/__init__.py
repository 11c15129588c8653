"""Stateful operators over Structured Streaming."""
