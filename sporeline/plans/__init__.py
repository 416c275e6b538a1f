"""Plans made of operators: single steps, whole runs, and exact event times."""
