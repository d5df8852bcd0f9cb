"""Functions of the rule engine."""
