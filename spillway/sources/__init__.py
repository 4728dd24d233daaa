"""Sources: generated rows, files, JDBC tables, Kafka topics, and generators of public streaming benchmarks."""
