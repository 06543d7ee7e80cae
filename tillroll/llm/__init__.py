"""Operators for preparing training corpora: similarity joins, quality
scores, packing, pseudonyms, tokenizing, record files, fingerprints, vector
search, language-model scores and token counts."""
