"""Shared column expressions, aggregation building blocks and the event vocabulary."""
