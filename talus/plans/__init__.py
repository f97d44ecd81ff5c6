"""Composed plans: the product pipeline and its workflows."""
