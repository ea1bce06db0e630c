"""Training-data operators: deduplication, filtering, mixing, packing, token
counts, search and language-model scoring over corpus tables.

Every operator is a function from DataFrames to a DataFrame; ``queries.py``
binds them to the corpus tables under ``opN_<name>``. Nothing
outside this package imports it, except the guarded hook of the driver
contract.
"""
