"""The mixed order reaches the pipeline's result."""

from collections import Counter

import corpus_pipeline
from fidelis.llm import queries

from test_corpus import brute_mix


def test_the_last_stage_returns_the_mixed_order(spark, docs, rows):
    sources = docs.selectExpr("doc_id", "text", "lang", "concat('src', substr(source, 2)) source", "n_chars")
    out = corpus_pipeline.encode(spark, corpus_pipeline.mix_sources(spark, sources, "").repartition(5), "").collect()
    want = brute_mix([(r[0], r[3] and f"src{r[3][1:]}") for r in rows], queries.SHARES, 1, queries.BLOCK, "mix")
    assert Counter((r["doc_id"], r["mix_position"]) for r in out) == want
    assert all(r["mix_slot"] == r["mix_position"] // queries.BLOCK and r["round_trip"] for r in out)
    assert len({r["mix_position"] for r in out}) == len(rows)
