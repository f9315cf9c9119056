"""Composed flows built from the operators."""
