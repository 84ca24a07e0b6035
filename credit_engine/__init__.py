"""Lending decisions for small businesses as Spark plans."""
