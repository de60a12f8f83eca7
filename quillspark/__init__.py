"""Spark jobs for curating large corpora of long-form text."""
