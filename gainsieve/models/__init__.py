"""Classifiers that cross-validate as Spark jobs."""
