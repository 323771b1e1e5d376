"""Whole jobs: harvest logs into the store, and report queries and tables over the store."""
