"""Keyword-trend and text-evidence analytics as Spark DataFrame transforms."""
