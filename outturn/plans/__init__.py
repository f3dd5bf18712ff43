"""Registered queries over the provided tables, with the SQL each one is checked against."""
