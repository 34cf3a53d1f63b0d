"""heron.plans."""
