"""Cairn: a PySpark library for tables of points, labels, instances, graphs, embeddings and predictions."""
