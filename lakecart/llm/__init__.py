"""Operators for training-data pipelines (tokenising, scans, language ID, quality, near
duplicates, toxicity, licences, language-model scores, packing).

Nothing else in the library imports this folder.  Every operator takes DataFrames, reads
only the columns it needs (extra columns, also ones that clash with its own names, are
ignored) and returns a DataFrame.
"""
