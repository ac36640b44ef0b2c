"""Complaint analytics as Spark DataFrame operators."""
