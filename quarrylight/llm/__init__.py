"""Training-data operators: ten Spark jobs over document, page and benchmark tables."""
