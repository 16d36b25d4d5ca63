"""Continuous ingest of posts."""
