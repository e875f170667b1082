"""Operators for preparing training data: one module per operator, and the queries that apply them."""
