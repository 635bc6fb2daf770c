"""Stylometric text analytics expressed as PySpark DataFrame plans."""
