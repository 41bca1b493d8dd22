"""Document structuring and corpus preparation as Spark jobs."""
