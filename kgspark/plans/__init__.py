"""Composite jobs, the mapping of the given tables onto the domain, and the query catalog."""
