"""twinsift: similarity, uniqueness and corpus analytics on Spark DataFrames."""
