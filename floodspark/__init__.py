"""Flood-alert analytics as Spark DataFrame jobs."""
