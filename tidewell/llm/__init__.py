"""Training-data operators: filters, archives, de-duplication, tokens, search and packing.

Nothing outside this folder imports it.  Each operator lives in a module of its own and keeps a
general interface; ``queries.py`` holds the thin registered queries.
"""
