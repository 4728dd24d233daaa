"""Structured Streaming: running sinks, and the stateful operators that Spark has no operator for."""
