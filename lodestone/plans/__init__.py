"""Registered queries with the SQL that an independent engine can run on the same tables."""
