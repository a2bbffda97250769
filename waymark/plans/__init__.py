"""Registered queries with the SQL that each must equal."""
