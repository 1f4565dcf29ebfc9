"""Bulk address registry jobs on Spark."""
