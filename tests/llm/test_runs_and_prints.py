"""Periodic runs and SimHash components against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from fidelis.llm import periodic_runs, queries, simhash_anchors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """All runs by looking at each stretch of each period, the smallest period first."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            m = j - i + q
            if m >= max(6, 4 * q) and not any(all(words[x] == words[x + d] for x in range(i, i + m - d)) for d in range(1, q)):
                out.append((i, m, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, rewritten=True):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if rewritten and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_are_the_brute_force_ones(spark, docs, rows, empty):
    small = [(r[0], r[1]) for r in rows if len(r[1] or "") < 5000]
    df = spark.createDataFrame([(*r, 1) for r in small], "doc_id bigint, text string, n_runs int")
    want = Counter(brute_row(*r) for r in small)
    assert Counter(map(tuple, periodic_runs.periodic_runs(df).collect())) == want
    # lags in ranges by several tasks: the same rows
    for size in (0, 40):
        assert Counter(map(tuple, periodic_runs.periodic_runs(df, range_bytes=size or 1).collect())) == want
    assert periodic_runs.periodic_runs(empty).collect() == []
    assert periodic_runs.periodic_runs(docs).count() == len(rows)


def test_runs_within_runs():
    rng = random.Random(9)
    for _ in range(300):
        words = []
        while len(words) < rng.randint(1, 60):
            words += [rng.choice("ab") for _ in range(rng.randint(1, 4))] * rng.randint(1, 7)
            words += [rng.choice("abc")] * rng.randint(0, 7)
        both = [[w.encode() for w in words], [w.encode() for w in words[: len(words) // 2]]]
        found = periodic_runs.scan(*periodic_runs.ids_of(both))
        for k, x in enumerate(both):
            own = [w.decode() for w in x]
            assert sorted((r[1:] for r in found if r[0] == k), key=lambda r: (r[0], r[2])) == brute_runs(own)
        parts = [r for a in range(0, len(words) // 4, 3) for r in periodic_runs.scan(*periodic_runs.ids_of(both[:1]), a + 1, a + 3)]
        assert sorted(r[1:] for r in parts) == sorted(r[1:] for r in found if r[0] == 0)


def test_runs_of_a_very_long_text(spark):
    rng = random.Random(3)
    words = [rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(60_000)]
    words[10_000:22_000] = words[10_000:13_000] * 4
    df = spark.createDataFrame([(7, " ".join(words)), (7, " ".join(words)), (None, "a " * 150_000)], "doc_id bigint, text string")
    got = periodic_runs.periodic_runs(df, range_bytes=30_000).collect()
    assert Counter((r["start"], r["length"], r["period"]) for r in got)[0, 150_000, 1] == 1
    assert [(r["length"] >= 12_000, r["period"], r["exponent_milli"]) for r in got if r["doc_id"] == 7] == [(True, 3000, 4000)] * 2


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable, by comparing everything; ``prints`` of (id, fingerprint)."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bits = np.array([f for _, f in prints], np.uint64)
    for k, (i, _) in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(bits[k + 1 :] ^ bits[k]) <= 4).tolist():
            a, b = find(i), find(prints[k + 1 + j][0])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_simhash_is_the_brute_force_one(spark, docs, rows, empty):
    out = simhash_anchors.simhash(docs).collect()
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in out) == Counter((i, f"{f:016x}") for i, f in prints)
    first = sorted({(i, f) for i, f in prints if i is not None})
    assert len({i for i, _ in first}) == len(first)
    want = brute_components(first)
    assert all(r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) for r in out)
    assert simhash_anchors.simhash(empty).collect() == []


def test_long_texts_are_counted_in_parts(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["Ab", "é", "cde", "f"]) + str(rng.randint(0, 99)) for _ in range(210_000))
    assert simhash_anchors._of_long(text.encode().translate(simhash_anchors.LOWER).split()) == plain_fingerprint(text)
    got = simhash_anchors.fingerprints(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert got["f"] % (1 << 64) == plain_fingerprint(text)


def test_no_neighbour_is_missed():
    rng = np.random.default_rng(5)
    code = simhash_anchors.Covering()
    x = rng.integers(0, 1 << 64, 400, np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for k in rng.choice(64, rng.integers(0, 6), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(k)
    (r, a, home), (q, b, _) = code.members(x), code.members(y)
    assert set(zip(r[home].tolist(), a[home].tolist(), strict=True)) < set(zip(r.tolist(), a.tolist(), strict=True))
    assert len(set(zip(r.tolist(), a.tolist(), strict=True))) == len(r) and a.max() < simhash_anchors.ANCHORS
    visited = set(zip(q.tolist(), b.tolist(), strict=True))
    met = {i for i, anchor in zip(r[home].tolist(), a[home].tolist(), strict=True) if (i, anchor) in visited}
    assert met == set(range(len(x)))


@pytest.mark.parametrize("tile", [2048, 6])
def test_components_of_clusters(spark, tile):
    """Chains and dense clusters of fingerprints; small tiles take the way of large anchors."""
    rng = np.random.default_rng(tile)
    values = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for _ in range(int(rng.choice([1, 3, 60]))):  # a walk: neighbours link, its ends do not
            values.add(x)
            for k in rng.choice(64, int(rng.integers(1, 7)), replace=False).tolist():
                x ^= 1 << k
    core = int(rng.integers(0, 1 << 64, dtype=np.uint64))
    for _ in range(150):  # a dense cluster
        values.add(core ^ sum(1 << k for k in rng.choice(64, int(rng.integers(0, 5)), replace=False).tolist()))
    values |= {0, 1 << 63, (1 << 64) - 1, 0b1111, 0b111110000}
    ids = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in ids], "f bigint")
    roots = {r["node"]: r["root"] for r in simhash_anchors.linked(df, tile=tile).collect()}
    want = brute_components(list(enumerate(ids)))
    signed = [int(np.uint64(v).view(np.int64)) for v in ids]
    groups = {}
    for i, r in want.items():
        groups.setdefault(r, set()).add(signed[i])
    for members in groups.values():
        assert {roots.get(m, m) for m in members} == {min(members)}


def test_queries_take_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.op12_periodic_runs(spark, sf).count() == n == queries.op13_simhash_anchors(spark, sf).count()
