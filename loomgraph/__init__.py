"""Conversation-graph analytics on Spark: ingest, store, refresh and query many webs of threads at once."""
