"""Training-data operators: ten self-contained building blocks for large text corpora."""
