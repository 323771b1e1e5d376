"""Inputs: the date calendar, log files, log lines, and the bundled access-log relation."""
