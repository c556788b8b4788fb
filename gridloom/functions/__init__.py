"""Column functions: vectors, hyperbolic geometry, golden-ratio weights, bits and bytes."""
