"""Registered queries: operators applied to the tables of a directory, with the SQL that says the same."""
