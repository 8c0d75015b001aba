"""The message pipeline under Structured Streaming."""
