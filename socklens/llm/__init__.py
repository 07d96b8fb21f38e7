"""Operators of a training-data pipeline over a table of documents.

One module per operator; ``queries`` applies each to its whole table. Nothing
outside this folder and ``corpus_pipeline.py`` imports from here.
"""
