"""A Spark-native multi-vector retrieval engine: passaging, codebooks, sparse postings, search and evaluation."""
