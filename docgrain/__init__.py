"""docgrain: structured-document analytics expressed as Spark DataFrame operations."""
