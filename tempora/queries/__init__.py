"""Registered queries: each operator on the driver's tables, with SQL to check it."""
