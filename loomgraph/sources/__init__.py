"""Sources and sinks of web tables."""
