"""Whole jobs put together from the operators, and the views they read."""
