"""Maritime awareness and corpus preparation as Spark jobs."""
