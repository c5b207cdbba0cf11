"""Structured Streaming use of the row-local operators (formatting, extraction, scoring)."""
