"""Graph operators: patterns as joins, traversals as level-wise joins, mutations as upserts."""
