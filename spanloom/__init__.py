"""Span analytics on Spark: annotation ETL, span matching, scoring, auditing and corpus curation."""
