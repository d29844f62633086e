"""Table, document and request-log sources and sinks."""
