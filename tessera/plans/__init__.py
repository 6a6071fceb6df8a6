"""Queries over the fixture tables, each with the SQL that gives the same rows where SQL can express it."""
