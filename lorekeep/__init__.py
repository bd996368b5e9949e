"""Lorekeep: knowledge retrieval and code-graph analytics as DataFrame transformations."""
