"""Event-time pipelines on Structured Streaming."""
