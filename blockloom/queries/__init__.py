"""Queries over the data folder, one per operator, with the SQL that gives the same rows."""
