"""Audits and counts over rows as they arrive."""
