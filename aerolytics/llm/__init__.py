"""Training-data operators: deduplication, filtering, tokenization, packing.

Every operator takes a DataFrame of documents plus the names of its id and text
columns, reads only those (so extra columns never clash), and states in its
docstring what null, empty, repeated and very long input yields.
"""
