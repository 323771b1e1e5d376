"""Web access-log analytics as Spark jobs: log lines to daily aggregates to report tables."""
