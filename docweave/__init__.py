"""docweave: analytics over collections of linked documents, expressed as Spark DataFrames."""
