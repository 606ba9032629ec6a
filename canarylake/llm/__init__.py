"""Operators for training-data pipelines over the synthetic text tables.

Each module holds one operator; :mod:`canarylake.llm.queries` registers one
query per operator.  Nothing else in the library imports this subpackage.
"""
