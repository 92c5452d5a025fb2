"""Symbolic-dynamics analytics on Spark."""
