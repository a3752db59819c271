"""Evidence retrieval and analytics on Spark: text in, ranked and checked rows out."""
