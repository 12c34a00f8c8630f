"""Structured Streaming jobs and the stateful admission limiter."""
