"""Source-linked evidence analytics and corpus preparation as Spark jobs."""
