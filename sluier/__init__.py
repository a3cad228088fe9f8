"""De-identification of free-text records as Spark jobs."""
