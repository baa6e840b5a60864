"""Column -> Column helpers shared by the jobs."""
