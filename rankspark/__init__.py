"""Ranked retrieval and its evaluation, expressed as Spark DataFrame plans."""
