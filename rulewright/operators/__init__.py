"""Operators of the rule engine."""
