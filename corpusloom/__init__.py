"""Spark jobs that build, index, search and audit large document corpora."""
