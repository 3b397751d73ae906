"""lakeloom: warehouse, graph, retrieval and paging queries on Spark DataFrames."""
