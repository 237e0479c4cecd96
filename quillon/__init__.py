"""Relational query engine and expression language compiled to lazy Spark DataFrame plans."""
