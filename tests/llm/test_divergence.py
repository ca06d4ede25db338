"""Source divergence against plain loops and SQL."""

import re
import string
from collections import Counter, defaultdict

import duckdb

from fidelis.llm import queries, source_divergence

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least_docs=30, prior=5, scale=10**9, top=50):
    """``rows`` of (lang, source, text)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(source_divergence.TERM, (text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= least_docs}

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept) + prior * len(kept)
            return {t: 1 + scale * (c[t] + prior) // n for t in kept}

        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_is_the_brute_force_one(spark, docs, rows, empty):
    own = [(r[2], r[3], r[1]) for r in rows]
    for least, top in ((30, 50), (2, 3), (10_000, 50)):
        got = rows_of(source_divergence.source_divergence(docs, least_docs=least, top=top))
        assert got == brute(own, least, top=top) and len({r[:5] for r in got}) == len(got)
    # a language without kept terms has pairs of value 0
    assert {r[4] for r in rows_of(source_divergence.source_divergence(docs, least_docs=10_000))} == {0}
    assert rows_of(source_divergence.source_divergence(empty)) == []


def test_divergence_of_odd_letters_and_columns(spark):
    texts = ["ÉTÉ été É", "İI ſ K", "a\x00b", "a1b_c`D[e", "x" * 100_000, "ab " * 50_000, "…—“q”", None, "", "日本 語"]
    rows = [(k, t, lang, source) for k, t in enumerate(texts) for lang in ("en", None, "") for source in ("s", "S", None, "ß")] * 2
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, source string, term string, salt int")
    assert rows_of(source_divergence.source_divergence(df, least_docs=3)) == brute([(lang, s, t) for _, t, lang, s in rows], 3)


def test_divergence_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(f"SELECT lang, source, part, item, value, rank FROM ({queries.ORACLE_SQL['op11_source_divergence']})").fetchall()
    assert rows_of(queries.op11_source_divergence(spark, sf)) == sorted(want)
