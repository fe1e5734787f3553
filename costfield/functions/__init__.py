"""Column functions: projections, attributes of features, scales."""
