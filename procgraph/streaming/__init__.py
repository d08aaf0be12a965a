"""Structured Streaming over invocation and event logs."""
