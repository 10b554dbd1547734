"""Prompt-history analytics and corpus operators as plain Spark DataFrame jobs."""
