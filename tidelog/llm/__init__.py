"""Operations of a training-data pipeline: filters, packing, search, near-duplicates.

Nothing else in the library imports this subpackage.
"""
