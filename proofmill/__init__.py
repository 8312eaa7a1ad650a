"""Spark jobs that build and study test-oracle corpora from Java sources and machine-written unit tests."""
