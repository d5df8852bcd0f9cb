"""Rulewright: rule catalogues and data-quality checks as Spark plans."""
