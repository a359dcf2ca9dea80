"""DataFrame operators on tasks: flattening, predicates, metrics, payloads."""
