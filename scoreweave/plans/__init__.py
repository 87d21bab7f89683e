"""Metric implementations, benchmark definitions, run planning and whole scoring runs."""
