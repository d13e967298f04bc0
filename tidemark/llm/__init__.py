"""Training-data operators.

Nothing else in the library imports this subpackage, so it can be removed as
a whole.  Each operator lives in its own module; :mod:`tidemark.llm.registry`
lists the queries built from them.
"""
