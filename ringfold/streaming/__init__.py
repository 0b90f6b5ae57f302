"""The same aggregates kept up to date by Structured Streaming."""
