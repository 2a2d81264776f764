"""Scalar functions: built from Spark's own expressions, so that they stay inside code generation."""
