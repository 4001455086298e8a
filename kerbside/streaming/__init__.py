"""Structured Streaming forms of landing, Silver, rolling sums and state."""
