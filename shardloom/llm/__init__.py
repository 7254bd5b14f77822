"""Training-data operators: scoring, scanning, de-duplication, mixing and token output.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general interface; ``entry`` holds the thin registered queries.
"""
