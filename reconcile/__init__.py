"""Analyse, move and verify tables with Spark DataFrame jobs."""
