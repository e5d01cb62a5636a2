"""Spark jobs for retrieval, evidence and evaluation over large text collections."""
