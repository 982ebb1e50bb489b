"""Distributed building blocks the plans share."""
