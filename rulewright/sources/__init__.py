"""Sources of the rule engine."""
