"""heron.streaming."""
