"""Schemas, logical plans, their rewriting and lowering, and the plan-text front end."""
