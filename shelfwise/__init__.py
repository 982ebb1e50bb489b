"""Inventory and sales analytics as Spark DataFrame plans."""
