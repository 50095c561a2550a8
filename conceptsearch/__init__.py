"""Concept search on Spark: sparse autoencoder codes, a concept inverted
index, dense and concept-level retrieval, training-set assembly and IR
metrics, all as DataFrame-to-DataFrame operators."""

__version__ = "0.1.0"
