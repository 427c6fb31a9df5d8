"""Registered query programs and the SQL each is checked against."""
