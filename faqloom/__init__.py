"""Question-answering text data on Spark: tokens, vocabularies, features, batches, ranking and metrics."""
