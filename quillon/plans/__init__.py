"""Statements to lazy Spark plans."""
