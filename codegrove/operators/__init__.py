"""DataFrame operators: search, graph, references, chunking, snapshots, cache."""
