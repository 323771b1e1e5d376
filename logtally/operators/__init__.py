"""Relational steps: lines to requests, requests to daily aggregates, devices, filters."""
