"""Registered queries: each one runs an operator over the whole test tables."""
