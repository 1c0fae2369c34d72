"""Training-data operators: ten corpus jobs over documents and web pages, each a set of Spark stages."""
