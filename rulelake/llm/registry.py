"""Queries and SQL oracles of the training-data operators; the pipeline's are in corpus_pipeline at the repository's top."""

from __future__ import annotations

from . import audio, bytebpe, chat, lmscore, merkle, negatives, ngramjoin, oracles, packing, quality, secrets, sharding, toxicity, urls

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_packing": packing.op2_packing,
    "op3_secrets": secrets.op3_secrets,
    "op4_chroma": audio.op4_chroma,
    "op5_quality": quality.op5_quality,
    "op6_lm_score": lmscore.op6_lm_score,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_ngram_join": ngramjoin.op8_ngram_join,
    "op9_byte_bpe": bytebpe.op9_byte_bpe,
    "op10_preferences": chat.op10_preferences,
    "op11_urls": urls.op11_urls,
    "op12_merkle": merkle.op12_merkle,
    "op13_negatives": negatives.op13_negatives,
}
ORACLES: dict[str, str] = {"op3_secrets": oracles.op3_sql(), "op5_quality": quality.op5_sql(), "op8_ngram_join": oracles.OP8_SQL, "op10_preferences": chat.OP10_SQL, "op11_urls": urls.OP11_SQL, "op12_merkle": merkle.op12_sql(), "op13_negatives": negatives.OP13_SQL}
