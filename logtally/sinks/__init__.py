"""Outputs: the aggregate store and tab-separated exports."""
