"""Column expressions: periods, geometry, text keys, predicates, scores."""
