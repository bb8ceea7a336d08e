"""Spark-native analytics engine for searching and curating collections of files, documents, pages and vectors."""
