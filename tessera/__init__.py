"""tessera: segment discovery and causal verification on Spark DataFrames."""
