"""tablewright: tabular analytics, data quality and governance as Spark jobs."""
