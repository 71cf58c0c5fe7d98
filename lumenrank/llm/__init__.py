"""Operations of a training-data pipeline: quality, fingerprints, dedup, packing, mixing, token files, PII.

Nothing outside this subpackage imports it.
"""
