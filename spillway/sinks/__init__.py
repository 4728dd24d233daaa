"""Sinks: console tables, files, JDBC tables, Kafka topics, memory."""
