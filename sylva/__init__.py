"""Trees as tables: path queries, transforms and versioned storage of hierarchical data on Spark."""
