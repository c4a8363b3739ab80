"""Structured Streaming: tails, change feeds, monitoring and the stateful session fold."""
