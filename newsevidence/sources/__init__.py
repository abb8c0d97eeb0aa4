"""Readers of landed payloads and tables, and the table sinks."""
