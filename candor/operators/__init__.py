"""DataFrame -> DataFrame operators: joins, clusters, graphs, roll-ups, campaigns."""
