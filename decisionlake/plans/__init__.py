"""End-to-end pipelines and the registered queries with their SQL twins."""
