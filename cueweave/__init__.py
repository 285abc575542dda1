"""Timed-transcript analytics and corpus preparation as Spark jobs."""
