"""Continuous forms of the quota, latency and cart jobs."""
