"""Sources and sinks: multi-file archives, chunk streams, whole files."""
