"""Column expressions: text features, scores, vectors."""
