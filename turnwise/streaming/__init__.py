"""Structured Streaming operators: live sessions and transcript jobs."""
