"""Operators on texts and on records without keys. Nothing outside this package imports it."""
