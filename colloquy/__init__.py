"""Dialogue-corpus preparation and rating analytics as Spark DataFrame jobs."""
