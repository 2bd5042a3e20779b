"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import bpe, fingerprints, html, jaccard, mixing, pii, pipeline, quality, secrets, urls, vectors


def queries() -> dict:
    return {
        "pipeline": pipeline.run,
        "op1_feistel_pseudonyms": pii.op1_feistel_pseudonyms,
        "op2_blob_ledger": secrets.op2_blob_ledger,
        "op3_bpe_tree": bpe.op3_bpe_tree,
        "op4_source_mix": mixing.op4_source_mix,
        "op5_universe_partition_join": jaccard.op5_universe_partition_join,
        "op6_itq_near_duplicates": vectors.op6_itq_near_duplicates,
        "op7_compression_quality": quality.op7_compression_quality,
        "op8_multiset_fingerprints": fingerprints.op8_multiset_fingerprints,
        "op9_tree_extraction": html.op9_tree_extraction,
        "op10_url_vocabulary": urls.op10_url_vocabulary,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_blob_ledger": secrets.oracle(),
        "op4_source_mix": mixing.ORACLE,
        "op10_url_vocabulary": urls.oracle(),
    }
