"""Operators for training-data pipelines.

Quality rules, near-duplicate search, decontamination, classifiers, substring
removal, secret scans, language-model scores, WARC archives and SentencePiece.
Nothing else in the library imports this package.
"""
