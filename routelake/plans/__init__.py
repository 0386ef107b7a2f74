"""Queries built of operators, and what plans share."""
