"""Spelling analysis of text and source trees on Spark."""
