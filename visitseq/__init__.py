"""Visit sequences from dated event tables, as Spark DataFrame jobs."""
