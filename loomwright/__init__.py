"""Curation, auditing and scoring of text corpora as Spark DataFrame operators."""
