"""Registered jobs over the input tables, and the SQL that gives the same rows."""
