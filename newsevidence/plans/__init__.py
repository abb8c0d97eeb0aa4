"""Whole flows: ingestion, claim checking, catalog sync."""
