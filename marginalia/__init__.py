"""Corpus-scale document analytics expressed as Spark DataFrame plans."""
