"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``embeddings``.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; its docstring states what it returns for nulls, empty
inputs, ties and repeated rows. Columns it does not need are never read, so
extra columns (whatever their names) change nothing.
"""
