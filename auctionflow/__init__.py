"""Event-stream analytics on Spark: auction queries, windows, state, graphs."""
