"""Operators of a large-scale training-data pipeline. Nothing else in the library imports this package.

    urlfilter   sorted digest array over URL rules and block lists
    ann         multiprobe p-stable hashing, nearest neighbours by cosine
    bpe         byte-level BPE encoding with offsets, and decoding
    neardup     SetSketch registers, banding, joint likelihood, exact check, components
    secretscan  base patterns and guess-cost dynamic programming
    quality     rule counts and a linear-chain CRF over lines
    mixing      Sainte-Lague block quotas and seeded block selection
    chat        prefix-target expansion of conversations
    licenses    winnowed fingerprints and banded alignment
    toxicity    FTRL-proximal logistic regression over hashed n-grams and skip-grams
"""
