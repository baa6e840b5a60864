"""Decision-history analytics as Spark DataFrame jobs."""
