"""Streaming of the rule engine."""
