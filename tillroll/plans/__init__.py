"""Pipelines (RAW -> STAGING -> MART) and the query registry."""
