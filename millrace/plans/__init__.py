"""Helpers that shape physical plans: scratch tables, keyed joins, graph components."""
