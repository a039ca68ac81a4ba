"""Matching and recommendation of text-rich items, written as Spark DataFrame functions."""
