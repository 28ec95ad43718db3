"""Research-matching data operators as Spark DataFrame jobs."""
