"""Spark-first corpus and tokenizer analytics."""
