"""Snapshot archives as tables, and tables as archives."""
