"""Operators for preparing text corpora: dedup, scoring, packing, attribution.

Every module holds one operator with its own general interface and a thin
``query`` function used by the entry file.  Nothing outside this subpackage
imports it.
"""
