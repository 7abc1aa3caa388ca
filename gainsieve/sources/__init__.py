"""Readers and writers: JSON lines, headered tables, scores, run logs."""
