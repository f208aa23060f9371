"""Operators that prepare text corpora for training: dedup, scans, quality, tokens, shards, packing.

Nothing outside this subpackage imports it.  All operators take and return
DataFrames.  Common rules, unless an operator's docstring says otherwise:

* a null text counts as the empty text;
* only the columns an operator names are read, so further columns of the input
  (whatever they are called) never clash with its own;
* a row without doc_id takes no part in comparing documents: it gets its own
  result as if it stood alone;
* repeated rows (same doc_id, same text) get the same result each;
* an empty table gives an empty result with the same columns.
"""
