"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quadloom.llm import bpe, embeddings, licenses, minhash, mixing, quality, secrets, topk, toxicity, warc

QUERIES = {
    "op1_bpe_round_trip": bpe.query,
    "op2_embedding_near_dedup": embeddings.query,
    "op3_warc_normaliser": warc.query,
    "op4_license_containment": licenses.query,
    "op5_minhash_groups": minhash.query,
    "op6_secret_ownership": secrets.query,
    "op7_topk_search": topk.query,
    "op8_source_mixing": mixing.query,
    "op9_quality_sites": quality.query,
    "op10_toxicity_lexicon": toxicity.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": embeddings.SQL,
    "op3_warc_normaliser": warc.SQL,
    "op4_license_containment": licenses.SQL,
    "op6_secret_ownership": secrets.SQL,
    "op7_topk_search": topk.SQL,
    "op8_source_mixing": mixing.SQL,
}
