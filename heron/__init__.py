"""heron."""
