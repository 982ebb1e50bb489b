"""Structured Streaming forms of the table-change jobs and the live figures."""
