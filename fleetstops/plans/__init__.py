"""Composite, user-visible questions built from the operators."""
