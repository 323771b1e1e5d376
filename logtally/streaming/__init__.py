"""Running totals over a stream of requests."""
