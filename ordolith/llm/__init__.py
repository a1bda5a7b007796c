"""Operators for preparing text corpora for language-model training.

Nothing outside this subpackage imports it. Each module holds one operator with
a general interface; ``registry`` binds them to the driver's tables.
"""
