"""Registered queries, each next to the SQL it is checked against."""
