"""heron.operators."""
