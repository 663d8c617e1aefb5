"""Training-data operators: cleaning, deduplication and tokenisation of document tables."""
