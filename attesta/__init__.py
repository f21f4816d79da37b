"""Citation-verified question answering over text corpora, as Spark jobs."""
