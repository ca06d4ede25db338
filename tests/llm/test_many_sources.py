"""Mixing more sources than one fold takes."""

import re
from collections import Counter, defaultdict

import pytest
from test_corpus import brute_mix

from fidelis.llm import mixing, queries


def test_op4_takes_many_sources(spark, tmp_path):
    spark.range(3000).selectExpr("id doc_id", "if(id % 400 = 399, null, concat('src', id % 400)) source").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op4_source_mixing(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(3000))
    assert sorted({r["mix_slot"] for r in out}) == list(range(400)) and len({r["mix_position"] for r in out}) == 3000


def test_many_sources_are_near_their_targets(spark):
    shares = {"s0": 900, "s1": 60, "s2": 7}
    docs = spark.range(9000).selectExpr("id doc_id", "case when id < 3600 then 's0' when id < 3900 then 's1' when id < 4000 then 's2' else concat('s', id % 1000 + 3) end source")
    for weights in (shares, shares | {"s0": 4000}):
        out = mixing.mix(docs, weights, block=2, many=True).collect()
        by, order = defaultdict(list), {}
        for r in out:
            by[r["source"]].append((r["mix_block"], r["mix_slot"], r["mix_position"]))
            order[r["mix_slot"]] = (r["source"], r["mix_on_target"])
        assert sorted(r["doc_id"] for r in out) == list(range(9000)) and len({r["mix_position"] for r in out}) == 9000
        assert sorted(order) == list(range(len(order))) == list(range(sum(-(-len(x) // 2) for x in by.values())))
        assert all(max(Counter(b for b, *_ in x).values()) <= 2 and sorted(x) == sorted(x, key=lambda y: y[2]) for x in by.values())
        total, given, on_target = sum(weights.values()) + 1000, Counter(), [s for _, (s, on) in sorted(order.items()) if on]
        assert len(on_target) == (total * 2 if weights is shares else 0)
        for t, s in enumerate(on_target, 1):
            given[s] += 1
            assert all(abs(given[x] - t * c / total) < 1 + 3 * c / total for x, c in [*shares.items(), ("s500", 1)])


def test_few_sources_keep_their_schedule(docs, empty):
    rows = lambda df: Counter((r["doc_id"], r["mix_position"]) for r in df.collect())
    assert rows(mixing.mix(docs, {"s0": 5}, block=4, many=True)) == rows(mixing.mix(docs, {"s0": 5}, block=4))
    assert mixing.mix(empty, {}, many=True).collect() == []


@pytest.mark.parametrize("sources", [190, 201, 700])
def test_the_schedule_does_not_depend_on_the_number_of_sources(spark, sources):
    rows = [(i, None if i % sources == 5 else f"s{i % sources if i > 400 else i % 3}") for i in range(3000)]
    shares = {"s0": 6, "s150": 3, "s2": 2, "absent": 4}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string"), shares, block=2, many=True).collect()
    want = brute_mix(rows, shares, 1, 2, "mix")
    assert Counter((r["doc_id"], r["mix_position"]) for r in got) == want


def test_many_sources_with_larger_shares_are_less_than_a_block_from_their_targets(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "if(id < 3000, concat('s', id % 300), if(id < 3600, 's7', concat('s', id % 240))) source")
    out = mixing.mix(docs, {"s7": 40}, default=3, block=1, many=True).collect()
    assert sorted(r["mix_position"] for r in out) == list(range(6000)) == sorted(r["doc_id"] for r in out)
    told = [r["source"] for r in sorted(out, key=lambda r: r["mix_slot"]) if r["mix_on_target"]]
    total, given = 40 + 3 * 299, Counter()
    assert len(told) == 3 * total
    for t, s in enumerate(told, 1):
        given[s] += 1
        assert all(abs(given[x] - t * (40 if x == "s7" else 3) / total) < 1 for x in ("s7", "s0", "s150", "s299", s))


def test_whole_rows_move_once(spark):
    docs = spark.range(500).selectExpr("id doc_id", "repeat('x', 9) text", "concat('s', id % 3) source")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = mixing.mix(docs, {"s0": 5}, block=4)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*row#", plan)) == 1
