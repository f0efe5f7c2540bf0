"""textmill: DataFrame-first text analytics, retrieval and evaluation on Spark."""
