"""Document similarity, authorship scoring and rubric analytics on Spark DataFrames."""
