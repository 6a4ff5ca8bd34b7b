"""Multi-step flows composed from sources, operators and sinks."""
