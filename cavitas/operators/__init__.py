"""DataFrame operators: geometry, joins, graph, clustering, registry."""
