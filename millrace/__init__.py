"""millrace: declarative fetch, map, validate and store pipelines on Spark DataFrames."""
