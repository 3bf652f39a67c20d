"""starflow: light-curve analytics and corpus preparation as Spark jobs."""
