"""Corpus analytics on PySpark: inventories, facts, retrieval, quality and evaluation as DataFrame operators."""
