"""Operators of a training-data pipeline: deduplication, tokenization, record
files, language and toxicity scoring, URL rules and decontamination.

Nothing else in the library imports this package. Every operator takes
DataFrames and names its id and text columns, so extra columns of its input
(whatever they are called) are never touched unless it filters whole rows.
"""
