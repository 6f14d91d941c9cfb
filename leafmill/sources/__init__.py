"""Scans: catalogs, packages, forms and uploads."""
