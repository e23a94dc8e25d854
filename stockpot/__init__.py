"""stockpot: retrieval, matching, ranking and data preparation as Spark DataFrame jobs."""
