"""heron.functions."""
