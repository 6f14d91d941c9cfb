"""Sinks: packages, JSON, report rows and ZIP batches."""
