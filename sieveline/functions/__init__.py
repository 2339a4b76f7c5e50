"""Column builders: scores, distances, geometry."""
