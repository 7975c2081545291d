"""Registered queries of the core and the SQL each is checked against."""
