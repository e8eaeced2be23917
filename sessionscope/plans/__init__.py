"""Report tables and the batch job that run several operators together."""
