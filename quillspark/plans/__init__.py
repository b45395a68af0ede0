"""Analyses composed of operators, and the queries registered for them."""
