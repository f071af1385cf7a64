"""Training-data operators: deduplication, mixing, tokenisation, quality, search and web archives."""
