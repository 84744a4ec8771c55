"""Passage and question library analytics on PySpark."""
