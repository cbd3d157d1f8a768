"""Spark-first document retrieval: ingest, index, rank and maintain document collections."""
