"""Ratings of item collections as Spark DataFrame operators."""
