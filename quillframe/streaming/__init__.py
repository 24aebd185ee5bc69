"""Windows and state over Structured Streaming."""
