"""Spark jobs over collections of text documents, vectors, links and history."""
