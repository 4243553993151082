"""Spark jobs for analysing a corpus of research papers at scale."""
