"""Operators for preparing text corpora.

One module per operator; each takes a DataFrame with at least ``doc_id`` and
``text`` and ignores columns it does not name. Nothing else in the package
imports this one.
"""
