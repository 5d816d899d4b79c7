"""Post-performance analytics on Spark: DataFrame in, DataFrame out."""
