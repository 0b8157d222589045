"""Suffix ordering of very large byte strings and text columns on Spark."""
