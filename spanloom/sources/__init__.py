"""Readers and writers of annotated corpora."""
