"""The functions over Structured Streaming."""
