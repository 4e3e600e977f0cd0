"""Operators for preparing text corpora: each module holds one operator, ``queries`` binds them to tables."""
