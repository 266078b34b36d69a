"""Simulated sensors and the incremental cleaner."""
