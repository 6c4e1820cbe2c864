"""Registered queries: every operator over the given tables, with an equivalent SQL text where one exists."""
