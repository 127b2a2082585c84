"""Procurement analytics on Spark: catalogue building, offer matching, selection."""
