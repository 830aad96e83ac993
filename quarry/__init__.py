"""quarry: deterministic text retrieval and corpus preparation, written as Spark DataFrame jobs."""
