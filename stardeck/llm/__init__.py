"""Operations of a training-data pipeline: filters, near-duplicates, packing, search and language-model scores.

Nothing else in the library imports this subpackage.
"""
