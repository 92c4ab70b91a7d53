"""Column functions: identifiers, ranking, paths."""
