"""Spark-native analytics over web corpora: pages, documents, logs, links, embeddings."""
