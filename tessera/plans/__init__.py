"""Compilers from query strings and patterns to column predicates."""
