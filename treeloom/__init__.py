"""Dependency-treebank analytics and training-data operators on PySpark."""
