"""Document intake and review as Spark jobs over DataFrames."""
