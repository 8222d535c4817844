"""Registered queries: each applies operators to the given tables, and has the SQL that says the same where SQL can."""
