"""fareflow: Spark jobs for public-transport smart-card records."""
