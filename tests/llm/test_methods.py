"""Methods against plain versions of them, and cases that strained them."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from fidelis.llm import common, html_extract, language_id, media, ngram_join, quality_classifier, quality_rules
from test_corpus import brute_join


def plain_kneser_ney(texts, alphabet):
    """Interpolated Kneser-Ney of order 4 by dictionaries: the probability of a symbol after three others."""
    seqs = []
    for t in texts:
        out = [""]
        for c in t.lower():
            c = c if c in alphabet else "?" if c.isalpha() else ""
            if c or out[-1]:
                out.append(c)
        seqs.append(out if not out[-1] else [*out, ""])
    flat = ["", "", "", *[c for s in seqs for c in s[1:]]]
    counts = {4: Counter(tuple(flat[i : i + 4]) for i in range(len(flat) - 3))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (len(alphabet) + 2)
        c = counts[n]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return max(c[gram] - d, 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:])

    return p


def test_language_model_is_plain_kneser_ney():
    texts = {"a": ["abca bcab", "cab abd"], "b": ["xyz abc", "zzy xa"]}
    model = language_id.Model(texts)
    number = {c: i + 1 for i, c in enumerate(model.symbols.letters)} | {"": 0, "?": len(model.symbols.letters) + 1}
    for column, lang in enumerate(model.langs):
        p = plain_kneser_ney(texts[lang], set(model.symbols.letters))
        for gram in ("abca", "xyzz", "bca?", "zzzz", "aaaa", "cab", "yz"):
            symbols = [""] * (4 - len(gram)) + list(gram)
            key = sum(number[c] << language_id.BITS * (3 - i) for i, c in enumerate(symbols))
            got = float(np.exp(model.log_probability(np.array([key], np.uint64), 4))[0, column])
            assert math.isclose(got, p(tuple(symbols)), rel_tol=2e-3), (lang, gram)


def test_many_alphabets_keep_their_letters():
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 6000)]
    model = language_id.Model({"han": ["".join(letters)], "en": ["plain words"]})
    codes, _ = model.symbols.encode(["".join(letters)])
    assert len(set(codes.tolist())) == 6001


def test_a_repeated_id_is_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"good words {i % 7} here", "en") for i in range(3000)] + [(2, "bad ***", "fr")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    seen = []
    keep = quality_classifier.Classifier
    try:
        quality_classifier.Classifier = lambda texts, marks: seen.append(texts) or keep(texts, marks)
        quality_classifier.fit(docs, labels)
    finally:
        quality_classifier.Classifier = keep
    assert all(len(t) <= 2 for t in seen)


def test_samples_are_thin_and_whole(spark):
    rows = spark.range(20_000).selectExpr("if(id % 100 = 0, 'rare', 'often') k", "id doc_id")
    got = Counter(r["k"] for r in common.sample_by_class(rows, "k", 150, []).collect())
    assert got == {"rare": 150, "often": 150}


def test_network_and_temperature_are_plain_loops():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 5)), (rng.random(80) > 0.4).astype(float)
    net = quality_classifier.Network(x, y, steps=30)
    w1, b1, w2, b2 = net.weights
    z = []
    for row in x:
        scaled = [min(max((v - m) / s, -8), 8) for v, m, s in zip(row, net.mean, net.scale, strict=True)]
        hidden = [math.tanh(sum(scaled[i] * w1[i, j] for i in range(5)) + b1[j]) for j in range(len(b1))]
        z.append(sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0])
    assert np.allclose(net.logits(x), z)
    net.calibrate(x, y)
    loss = lambda t: -sum(math.log(1 / (1 + math.exp(-(v if k else -v) / t))) for v, k in zip(z, y, strict=True))
    assert loss(net.temperature) <= min(loss(t) for t in np.geomspace(0.25, 10, 40)) + 1e-9


def test_fertility_measures_are_brute_force(docs, rows):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = defaultdict(list)
    for r in quality_rules.text_metrics(docs).collect():
        got[r["doc_id"]].append(r)
    for i, t, *_ in rows[:60]:
        words = (t or "").encode().split()
        ids = [x for w in words for x in library.encode(w.decode())]
        share = [n / len(ids) for n in Counter(ids).values()]
        r = got[i][0]
        assert r["n_tokens"] == len(ids)
        assert math.isclose(r["chars_per_token"], sum(len(w.decode()) for w in words) / max(len(ids), 1))
        assert math.isclose(r["byte_share"], sum(library.is_byte(x) for x in ids) / max(len(ids), 1))
        bits = -sum(s * math.log2(s) for s in share) / math.log2(max(min(len(ids), library.get_piece_size()), 2))
        assert math.isclose(r["token_entropy"], bits, abs_tol=1e-9)


def test_words_of_long_texts_hash_as_in_short_ones(monkeypatch):
    texts = ["one two  three", "", "x" * 50 + " y", "a " * 40, None, "tail word\n"]
    want = ngram_join.word_hashes(pa.array(texts))
    monkeypatch.setattr(ngram_join, "AT_ONCE", 7)
    got = ngram_join.word_hashes(pa.array(texts))
    assert all((a == b).all() for a, b in zip(want, got, strict=True)) and len(want[0]) == 3 + 2 + 40 + 2


def test_sets_with_the_same_first_key_stay_apart(spark, monkeypatch):
    keys = ngram_join.class_keys

    def coarse(flat, offsets):
        k, k2 = keys(flat, offsets)
        return np.where(k < 0, k, k % 5), k2

    rng = random.Random(8)
    own = [(i, " ".join(rng.choice("abcdefgh") for _ in range(12))) for i in range(40)]
    own += [(100 + i, t) for i, t in own[:10]] + [(200 + i, t + " z") for i, t in own[:10]]
    monkeypatch.setattr(ngram_join, "class_keys", coarse)
    docs = spark.createDataFrame(own, "doc_id bigint, text string")
    assert Counter(map(tuple, ngram_join.ngram_join(docs, 3, 80).collect())) == brute_join(own, 3, 80)


def test_sparse_and_dense_columns_give_the_same_overlaps():
    rng = random.Random(2)
    base = list(range(1000, 1060))
    sets = []
    for i in range(40):
        s = set(base) if i % 2 else set(rng.sample(base, 50))
        s = set(list(s)[: rng.randint(40, len(s))]) | {rng.randint(0, 200) for _ in range(12)}
        sets.append(sorted(s))
    flat = np.array([x for s in sets for x in s], np.int64)
    sizes = np.array(list(map(len, sets)))
    left = np.array([i % 3 > 0 for i in range(40)])
    key = np.arange(40)
    got = ngram_join.tile_links(key, left, key.copy(), flat, sizes, 60, block=16)
    pairs = [(a, b) for a in range(40) for b in range(a) if (left[a] or left[b]) and 100 * len(set(sets[a]) & set(sets[b])) >= 60 * len(set(sets[a]) | set(sets[b]))]

    def groups(links):
        root = list(range(40))
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in links:
            root[find(a)] = find(b)
        return {frozenset(i for i in range(40) if find(i) == find(j)) for j in range(40)}

    assert pairs and groups(got) == groups(pairs) and all(p in pairs or p[::-1] in pairs for p in got)


def test_many_short_documents_with_one_template_line(spark):
    """They share most of their n-grams and are still too far apart to link: no pairs of all of them arise."""
    line = "this page was made by the same template as all of the others on this site"
    docs = spark.range(20_000).selectExpr("id doc_id", f"concat('{line} ', md5(string(id)), ' ', md5(string(-id)), ' ', md5(string(id + 7)), ' ', md5(string(id * 3))) text")
    got = ngram_join.ngram_join(docs)
    assert got.where("doc_id = component_id").count() == 20_000


def test_memo_is_bounded_by_bytes():
    memo = common.Memo(lambda words: [len(w) for w in words], most_bytes=100_000)
    for i in range(50):
        words = [f"{i}-{j}-" + "x" * 20 for j in range(100)] + ["y" * 10_000 + str(i)]
        known = memo.need([words])
        assert [known[w] for w in words] == [len(w) for w in words]
        assert len(memo.known) < 900 and sum(len(w) > 64 for w in memo.known) == 1


def test_media_columns_have_addresses_and_headers(docs, rows, tmp_path):
    got = media.media_columns(docs, f"file://{tmp_path}/m").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["width"] == 64 and r["depth"] == 8 and r["height"] * 64 == r["payload_bytes"]
        assert r["digest"] == r["payload_sha256"] and r["length"] == r["media_bytes"]
    r = got[0]
    data = (tmp_path / "m" / r["shard"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
    assert media.samples_of(data).tobytes()[: r["n_bytes"]] == next(t for i, t, *_ in rows if i == r["doc_id"] and len((t or "").encode()) == r["n_bytes"]).encode()


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "deep " * 40, "<p>" * 20_000, "<ul><li>" * 10_000 + "x", "</div>" * 20_000, "<b>" * 20_000 + "x"])
def test_broken_nesting_takes_linear_time(page):
    import time

    begun = time.perf_counter()
    html_extract.Page(page)
    assert time.perf_counter() - begun < 5


def test_formulas_and_fallback_texts_stay():
    words = "a sentence of several plain words that runs on for a while " * 3
    text = html_extract.fit().extract([f"<article><p>{words}Formula <math><mi>x</mi></math> end</p><p>{words}</p></article>"])[0][0]
    assert "Formula x end" in text
