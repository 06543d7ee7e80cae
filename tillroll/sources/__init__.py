"""Typed sources and sinks, landing tables and the test-data adapter."""
