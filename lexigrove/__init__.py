"""Document intelligence and retrieval on Spark."""
