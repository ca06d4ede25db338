"""Small documents with every odd case: nulls, empty and long texts, ties, repeated rows, other columns."""

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, k string, tile int"
ODD = [
    None, "", " ", "\n\n", "a", "Hello", "It's we'll don't 'S ' s", "a b c d e a b c d e", "a  b   c", "   lead", "trail   ", "x\n\n y\t\tz  \n q", "foo \nbar", "<|endoftext|>a<|endoftext|>", " <|endoftext|> b",
    "日本語のテキスト " * 20, "aaaa" * 300, " " * 50 + "x" + " " * 201, "éèç " * 100, "x　y  z\x1c\x1dq\x85r", "12345 67 8'9", "😀😀 👩‍👩‍👧", "▁a▁▁b ▁", "=" * 1000 + "ab", "\x00\x01 a", "<s> </s> <0x41>",
    "Word*** other### THIS!! | table", "the quick brown fox jumps over the lazy dog " * 30,
]


def words(rng, n, stems):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(4)
    stems = {"en": ["th", "er", "ing", "on", "wh", "ly"], "fr": ["é", "eau", "oi", "le", "ment", "que"], None: ["x", "zz", "q"]}
    out = []
    for i, t in enumerate(ODD):
        out.append((i, t, None if i % 5 == 0 else "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)))
    for i in range(len(ODD), 220):
        lang = ["en", "fr", None][i % 3]
        t = words(rng, rng.randint(12, 260), stems[lang])
        out.append((i, t, lang, f"s{i % 3}", len(t)))
    long = words(rng, 20_000, stems["en"])
    out += [(220, long, "en", "s0", len(long)), (221, long, "en", "s1", len(long)), (5, "Hello", "en", "s0", 5), (5, "Hello", "en", "s0", 5), (None, "no id here", "en", None, 10), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "extra", "extra", 7) for r in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
