"""Structured Streaming: keep the date-grain marts current as facts land."""
