"""Registered queries: each applies operators to the driver tables, with the SQL that must agree."""
