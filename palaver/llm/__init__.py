"""Training-data operators: dedup, scans, formatting, mixing and extraction over text corpora.

Nothing outside this package imports it.  ``queries`` holds the registered queries and their SQL.
"""
