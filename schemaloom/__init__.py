"""Schema-driven data quality and triple-graph analytics on Spark DataFrames."""
