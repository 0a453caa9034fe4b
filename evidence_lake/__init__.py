"""Bibliographic records and document text to traceable evidence, as Spark DataFrame operators."""
