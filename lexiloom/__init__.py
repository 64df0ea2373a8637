"""Corpus preparation, next-token modelling and reply scoring as Spark DataFrame jobs."""
