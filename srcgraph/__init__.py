"""srcgraph: source trees of many repositories as one typed system graph, on Spark."""
