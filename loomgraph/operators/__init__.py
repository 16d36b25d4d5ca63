"""Graph operators over the web tables."""
