"""Bookstore analytics as set-based Spark jobs."""
