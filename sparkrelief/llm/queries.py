"""Queries of the text operators, for the driver's entry module."""

from __future__ import annotations

from . import ann, bpe, langid, merkle, neardup, packing, pii, suffixes, toxicity, urls


def queries() -> dict:
    import corpus_pipeline

    found = (langid.op1_language_id, pii.op2_pii, suffixes.op3_suffix_dedup, bpe.op4_bpe, merkle.op5_fingerprints, urls.op6_url_filter, neardup.op7_minhash, toxicity.op8_toxicity, ann.op9_ann, packing.op10_packing)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """None of the queries has an SQL form that is both whole and quick; tests hold them against brute force."""
    return {}
