"""Operators for building training data from text: packing, deduplication, filters, encoders, models.

Each module holds one operator with an interface of its own; ``queries`` binds the operators to the
tables. Nothing else in the library imports this package.
"""
