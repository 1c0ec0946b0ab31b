"""Row-local forms for Structured Streaming."""
