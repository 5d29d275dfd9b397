"""Registered queries over the driver's tables, and inference jobs."""
