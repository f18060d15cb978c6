"""Answer validation as Spark DataFrame jobs."""
