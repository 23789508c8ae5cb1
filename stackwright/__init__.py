"""Document retrieval, quality and corpus jobs as Spark DataFrames."""
