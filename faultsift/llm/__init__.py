"""Operators for preparing large text corpora, each one a set of Spark jobs."""
