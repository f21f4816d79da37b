"""Operators that prepare training data: filters, deduplication, extraction, packing and token files.

Nothing outside this subpackage imports it.  Each operator takes and returns DataFrames;
:mod:`attesta.llm.queries` holds the thin ``opN_<name>`` queries.
"""
