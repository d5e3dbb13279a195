"""atlasgraph: code-graph analytics and training-data processing on Spark DataFrames."""
