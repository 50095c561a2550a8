"""Training-data operators: scanning, filtering, deduplicating, mixing and
sharding a corpus of documents.  Nothing outside this package imports it."""
