"""sporeline: spreading processes on graphs, and training-data operators, as Spark jobs."""
