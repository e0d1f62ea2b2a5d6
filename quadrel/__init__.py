"""quadrel: ontologies and knowledge graphs as Spark DataFrames."""
