"""Statements, plans, and what binds one to the other."""
