"""corpusmill: document preparation, retrieval and evaluation on Spark DataFrames."""
