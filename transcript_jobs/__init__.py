"""Spark jobs over timed transcripts, and (in ``llm``) over text corpora."""
