"""Ingestion of change streams."""
