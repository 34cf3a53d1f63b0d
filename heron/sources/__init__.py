"""heron.sources."""
