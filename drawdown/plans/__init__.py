"""Registered queries: operator bindings on the driver tables plus their oracle SQL."""
