"""Streams: uploads of packages, and the freshness of cached entries."""
