"""Sources and sinks of files."""
