"""Training-data operators: thirteen corpus-scale operations on documents, pages and vectors.

Nothing else in the library imports this subpackage.
"""
