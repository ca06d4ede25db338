"""Mixing, media, the n-gram join and the pipeline."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from fidelis.llm import media, mixing, ngram_join
from fidelis.llm.connected import components
from fidelis.llm.language_id import language_id  # noqa: F401  (the subpackage imports as a whole)

SF = "/root/testdata/sf0.01"


def order(slots, shares):
    """Brute force: earliest deadline first over one round."""
    given, out = dict.fromkeys(shares, 0), []
    for t in range(slots):
        ready = [(-(-(given[s] + 1) * slots // c), s) for s, c in shares.items() if given[s] < c and given[s] * slots // c <= t]
        due, s = min(ready)
        assert t < due
        out.append((s, given[s]))
        given[s] += 1
    return out


def brute_mix(rows, shares, default, block, seed):
    by = defaultdict(list)
    for doc_id, source in rows:
        text = seed if doc_id is None else f"{seed}:{doc_id}"
        by["null" if source is None else "s" + source].append((hashlib.md5(text.encode()).hexdigest(), doc_id))
    keys = sorted(by)
    q = {k: shares.get(k[1:], default) if k != "null" else default for k in keys}
    left = {k: -(-len(by[k]) // block) for k in keys}
    done, place, slot = dict.fromkeys(keys, 0), {}, 0
    while any(left[k] > done[k] for k in keys):
        c = {i: min(q[k], left[k] - done[k]) for i, k in enumerate(keys) if left[k] > done[k]}
        for i, b in order(sum(c.values()), c):
            place[keys[i], done[keys[i]] + b] = slot
            slot += 1
        for i, n in c.items():
            done[keys[i]] += n
    out = Counter()
    for k in keys:
        for i, (_, doc_id) in enumerate(sorted(by[k], key=lambda x: (x[0], x[1] is not None, x[1] or 0))):
            out[doc_id, place[k, i // block] * block + i % block] += 1
    return out


def test_mixing_is_the_brute_force_schedule(docs, rows, empty):
    shares = {"s0": 5, "s1": 2}
    got = mixing.mix(docs, shares, block=4)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert Counter((r["doc_id"], r["mix_position"]) for r in got.collect()) == brute_mix([(r[0], r[3]) for r in rows], shares, 1, 4, "mix")
    assert mixing.mix(empty, shares).collect() == []
    assert mixing.mix(empty, {}).collect() == []


def test_mixing_deviates_by_less_than_a_block(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "concat('s', least(id % 7, 4)) source")
    shares = {"s0": 13, "s1": 7, "s2": 3, "s3": 2, "s4": 29}
    slots = mixing.mix(docs, shares, block=2).where("mix_on_target").select("source", "mix_slot").distinct().orderBy("mix_slot").collect()
    total, given = sum(shares.values()), Counter()
    assert len(slots) > 200
    for t, r in enumerate(slots, 1):
        given[r["source"]] += 1
        assert all(abs(given[s] - t * c / total) < 1 for s, c in shares.items())


def test_too_many_sources_are_an_error(spark):
    docs = spark.range(300).selectExpr("id doc_id", "cast(id as string) source")
    with pytest.raises(Exception, match="sources"):
        mixing.mix(docs, {}).collect()
    assert mixing.shares_of({"a": 0.75, "b": 0.25}, 100) == {"a": 75, "b": 25}


def test_media_round_trip(docs, rows, empty, spark, tmp_path):
    got = media.media_columns(docs).collect()
    want = Counter()
    for i, t, *_ in rows:
        data = (t or "").encode()
        pad = data + bytes((-len(data) % 64) or (0 if data else 64))
        want[i, len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    same = defaultdict(set)
    for r in got:
        same[r["payload_sha256"]].add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in same.values())
    assert media.media_columns(empty).collect() == []


def test_media_headers_and_tar(docs, spark, tmp_path):
    import tarfile

    rows = media.store(docs, f"file://{tmp_path}/m")
    places = media.addresses(rows)
    heads = {r["digest"]: r for r in media.read_headers(places, f"file://{tmp_path}/m").collect()}
    pays = {r["digest"]: bytes(r["payload"]) for r in media.read_payloads(places, f"file://{tmp_path}/m").collect()}
    assert heads.keys() == pays.keys() and all(h["width"] == 64 and h["height"] * 64 == len(pays[d]) for d, h in heads.items())
    members = [m.name for p in (tmp_path / "m").glob("*.tar") for m in tarfile.open(p)]
    assert {m.removesuffix(".png") for m in members} == set(pays)


def brute_join(rows, width, percent):
    sets = {}
    for n, (_, t, *_) in enumerate(rows):
        w = (t or "").encode("utf-8", "replace").lower().split()
        sets[n] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    root = {n: n for n in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    live = [n for n in sets if sets[n] and rows[n][0] is not None]
    for a in live:
        for b in live:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for n in live:
        least[find(n)] = min(least.get(find(n), 1 << 60), rows[n][0])
    return Counter((rows[n][0], len(sets[n]), None if rows[n][0] is None else rows[n][0] if not sets[n] else least[find(n)]) for n in sets)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 100), (1, 50)])
def test_join_is_brute_force(spark, rows, width, percent):
    import random

    rng = random.Random(width)
    own = [r[:2] for r in rows if len(r[1] or "") < 5000]
    texts = [t for _, t in own if t and len(t.split()) > 20]
    for i in range(120):  # near copies at many distances, in chains
        w = rng.choice(texts).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
            w[rng.randrange(len(w))] = rng.choice(["new", "Other", "x"])
        own.append((1000 + i, " ".join(w)))
        texts.append(own[-1][1])
    docs = spark.createDataFrame([(*r, "x") for r in own], "doc_id bigint, text string, component_id string")
    got = Counter(tuple(r) for r in ngram_join.ngram_join(docs, width, percent, tile=8).collect())
    assert got == brute_join(own, width, percent)


def test_join_of_a_group_of_many_tiles(spark):
    """A chain of near copies that no pivot sees whole: links across tiles are found in the second round."""
    base = [f"w{i}" for i in range(60)]
    own = []
    for i in range(150):
        w = base[:]
        for j in range(i // 5):
            w[(7 * j) % 60] = f"v{j}"
        own.append((i, " ".join(w) + f" tail{i % 5}"))
    docs = spark.createDataFrame(own, "doc_id bigint, text string")
    assert Counter(tuple(r) for r in ngram_join.ngram_join(docs, 3, 80, tile=6).collect()) == brute_join(own, 3, 80)


def test_join_of_an_empty_table(empty):
    assert ngram_join.ngram_join(empty).collect() == []


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (10, 9), (9, 8), (8, 7), (7, 6), (20, 30), (30, 20)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 6, 9: 6, 8: 6, 7: 6, 6: 6, 20: 20, 30: 20}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", SF])
def test_pipeline(spark, sf):
    from fidelis.llm import quality_classifier, quality_rules

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram jaccard join", "source mixing", "sentencepiece"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        after = stage(spark, kept, sf).cache()
        now = {r["doc_id"] for r in after.select("doc_id").collect()}
        # The mixing stage adds its places, which the last stage returns.
        assert after.columns == corpus_pipeline.COLUMNS + (corpus_pipeline.PLACES if name == "source mixing" else []) and now <= before
        if name == "quality classifier":
            bad = quality_classifier.quality_classifier(kept, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0")
            assert before - now == {r["doc_id"] for r in bad.collect()}
        if name == "quality rules":
            assert before - now == {r["doc_id"] for r in quality_rules.quality_rules(kept).where("not kept").collect()}
        if name == "n-gram jaccard join":
            want = brute_join([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80)
            assert len(now) < len(before) and now == {i for i, _, c in want if i == c}
        if name == "source mixing":
            assert now == before
        kept = after
    if sf != SF:
        return
    out = corpus_pipeline.run(spark, sf)
    assert out.select("doc_id").distinct().count() == len(now) and out.where("not round_trip").count() == 0


def test_pipeline_stages_of_odd_rows(spark, docs, rows, empty, tmp_path):
    """Nulls, repeated ids, empty texts, other columns: each row is judged for itself and no column is lost."""
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        for table in (docs, empty):
            out = stage(spark, table, str(tmp_path))
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert (out.count() == 0) == (table is empty), name
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert sum(r["doc_id"] == 5 for r in kept) == 1 and sum(r["text"] is None for r in kept) == sum(r[1] is None for r in rows)
    long = [r["doc_id"] for r in kept if r["doc_id"] in (220, 221)]
    assert long == [220]
    last = corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()
    assert len(last) == len(rows) and len({r["mix_slot"] for r in last}) > 1
