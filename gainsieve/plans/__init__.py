"""Whole workflows: data preparation, experiments, reports."""
