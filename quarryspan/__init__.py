"""quarryspan: a Spark-first analytics engine for evidence retrieval data."""
