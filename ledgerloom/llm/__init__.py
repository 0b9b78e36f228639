"""Training-data operators, and the queries that run them on whole tables."""
