"""Spark jobs for governing corpora of text packages and preparing training text."""
