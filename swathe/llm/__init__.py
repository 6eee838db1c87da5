"""Operators for training-data corpora: de-duplication, filtering, tokenising, packing, archives.

Nothing else in the library imports this package. Every operator takes and returns DataFrames;
``queries`` registers one query per operator.
"""
