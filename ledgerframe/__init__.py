"""Chain-state analytics on Spark: DataFrame operators, sources and query templates."""
