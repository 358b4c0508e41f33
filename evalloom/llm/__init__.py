"""Training-data operators: deduplication, filtering, labelling and tokenisation of large corpora."""
