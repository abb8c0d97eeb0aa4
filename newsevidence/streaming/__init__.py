"""Structured Streaming front ends of the batch operators."""
