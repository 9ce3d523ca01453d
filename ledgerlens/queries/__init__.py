"""Queries of the operators beyond search and ranking, each with the SQL that gives the same rows."""
