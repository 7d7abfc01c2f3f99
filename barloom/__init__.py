"""barloom: market-bar features, labels and model-evaluation queries on Spark DataFrames."""
