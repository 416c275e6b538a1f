"""Column functions: counter-based random numbers and hazards."""
