"""tidelog: log analytics over records tables, expressed as Spark DataFrames and streams."""
