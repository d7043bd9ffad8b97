"""Operators for training-data corpora, one module per operator.

Nothing else in the library imports this subpackage.  Shared helpers are in
``tokens`` (vectorised tokenizing of Arrow batches), ``components``
(connected components) and ``common`` (tables, scratch folders).
"""
