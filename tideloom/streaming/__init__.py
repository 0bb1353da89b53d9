"""Structured Streaming behaviours."""
