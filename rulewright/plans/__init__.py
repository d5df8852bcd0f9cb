"""Logical plans: what to compute, left to Catalyst to place."""
