"""Transcript analytics expressed as Spark DataFrame plans."""
