"""Reconciliation analytics on Spark."""
