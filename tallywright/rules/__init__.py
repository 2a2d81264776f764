"""Audit rules over tables: what a rule is, and how many run in one pass."""
