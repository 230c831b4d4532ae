"""Training-data operators: quality, dedup, privacy, mixing, tokenizing.

Nothing outside this package imports it.  Each operator takes a DataFrame,
names its own key and text columns as parameters, and returns a DataFrame;
``queries.py`` registers one query per operator over the whole given tables.
"""
