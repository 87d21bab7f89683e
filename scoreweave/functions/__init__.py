"""Column builders, array helpers, distributed ordering and the metric registry."""
