"""Registered queries over the given tables, their input tables, and their SQL twins."""
