"""Registered queries and the tables they are built on."""
