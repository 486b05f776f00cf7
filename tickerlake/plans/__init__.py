"""Registered queries over the bound tables, with their checking SQL."""
