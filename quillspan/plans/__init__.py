"""Queries: importing a module of this package registers its queries."""
