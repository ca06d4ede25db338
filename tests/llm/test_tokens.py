"""Token counts, SentencePiece and token shards against the libraries themselves."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from fidelis.llm import byte_bpe, token_output
from fidelis.llm import sentencepiece_lattice as SL
from fidelis.llm.token_counts import Counter, RankMerger, token_counts

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(docs, rows, tokenizer):
    got = sorted(map(tuple, token_counts(docs).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(ids_of(tokenizer, t)), n > 512) for i, t, *_ in rows), key=str)
    assert got == want


def test_counts_of_an_empty_table(empty):
    assert token_counts(empty).collect() == []


TEXTS = st.text(st.sampled_from("ab the  ng\n\t.'$é日▁<|>0　"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_counts_and_ids_of_any_text(text):
    from tokenizers import Tokenizer

    t = test_counts_and_ids_of_any_text.__dict__.setdefault("t", (Tokenizer.from_file(JSON), Counter(JSON), token_output.Encoder(JSON), SL.Encoder(MODEL)))
    ids = ids_of(t[0], text)
    assert t[1].count([text]) == [len(ids)]
    assert t[2].encode([text]) == [struct.pack(f"<{len(ids)}I", *ids)]
    pieces = t[3].encode([text])[0]
    assert pieces.tolist() == t[3].pieces.library.encode(text)
    assert SL.decode(t[3].pieces, pieces) == text.replace("▁", " ")


def test_overlapping_pairs_merge_from_the_left():
    merger = RankMerger({"bytes": {b: b for b in range(256)}, "merges": {(97, 97): (0, 300), (300, 300): (1, 301)}})
    assert merger.count([b"a" * n for n in range(1, 9)]).tolist() == [1, 1, 2, 1, 2, 2, 3, 2]
    assert merger.count([]).tolist() == []


def test_chunks_join_to_the_text(rows):
    for _, text, *_ in rows:
        assert "".join(map(byte_bpe.spelled, byte_bpe.chunks(text or ""))) == (text or "")


def test_suffix_array_and_ranges():
    codes = np.array([3, 2, 3, 2, 3, 0], np.uint16)
    order = SL.suffix_array(codes, 16)
    assert [codes[i:].tolist() for i in order] == sorted(codes[i:].tolist() for i in range(6))
    low, high = SL.occurrence_ranges(codes, order, np.array([[3, 2, 0], [2, 3, 0], [9, 9, 0]], np.uint16), np.array([2, 2, 2]))
    assert [sorted(order[a:b].tolist()) for a, b in zip(low, high, strict=True)] == [[0, 2], [1, 3], []]


def test_pieces_are_the_librarys(docs, rows, empty):
    library = SL.Pieces(MODEL).library
    got = {(r["doc_id"], r["decoded"]): r["ids"] for r in SL.sentencepiece(docs).collect()}
    assert got == {(i, (t or "").replace("▁", " ")): library.encode(t or "") for i, t, *_ in rows}
    summary = SL.sentencepiece_summary(docs).collect()
    assert len(summary) == len(rows) and all(r["round_trip"] for r in summary)
    assert SL.sentencepiece(empty).collect() == []


def test_long_words_take_the_same_order():
    encoder = SL.Encoder(MODEL)
    for text in ("ab" * 400, "thing" * 60, "a" * 97, "=" * 333, " " * 500, "日本" * 90):
        assert encoder.encode([text])[0].tolist() == encoder.pieces.library.encode(text)


def test_shards_round_trip(docs, rows, tokenizer, empty):
    got = {}
    for r in token_output.token_output(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    packed = {}
    for i, t, *_ in rows:
        ids = ids_of(tokenizer, t) + [2]
        packed.setdefault(i, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    start = 0
    for i in sorted(packed, key=lambda x: (x is not None, x or 0)):
        assert sorted(x[1:] for x in got[i]) == sorted(packed[i])
        for s, n, _ in sorted(got[i]):
            assert s == start
            start += n
    assert token_output.token_output(empty).collect() == []


def test_marks_behind_a_word_are_not_learned_with_it(tokenizer):
    encoder, learned = token_output.Encoder(JSON), []
    learn = encoder.memo.learn
    encoder.memo.learn = lambda chunks: learned.extend(chunks) or learn(chunks)
    words = [f"wörd{'abcdefgh'[i]}ing" for i in range(8)]
    texts = [" ".join(w + m * 3 for w in words) for m in token_output.MARKS]
    assert encoder.encode(texts) == [struct.pack(f"<{len(ids)}I", *ids) for ids in (ids_of(tokenizer, t) for t in texts)]
    assert len(learned) <= len(words) + 2 * len(token_output.MARKS)  # words, marks, first words of texts


def test_texts_of_one_call_take_their_own_way(tokenizer, monkeypatch):
    monkeypatch.setattr(token_output, "STEP", 2)
    encoder = token_output.Encoder(JSON)
    plain = ["one two, three!! don't x1 -- &&& café's", "word", "word,", ", word", "ends here\n", "\nbegins so", "in\nside a\tb c\r\nd", "日本 語。 two"]
    odd = ["", " ", "  ", " one", "one ", "a  b", "a \n b", "a\n b", "a \tb", "wide\u3000space x", "\u3000", "x\xa0", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "two  <|endoftext|>\n"]
    for texts in ([t for pair in zip(plain, odd) for t in pair] + odd, plain, odd, odd[:1], []):  # noqa: B905 (the rest of odd follows)
        for given in (texts, pa.array(["cut", *texts], pa.string()).slice(1), pa.array(texts, pa.large_string())):
            assert encoder.encode(given) == [struct.pack(f"<{len(ids)}I", *ids) for ids in (ids_of(tokenizer, t) for t in texts)]


def test_batches_are_joined_within_bounds(monkeypatch):
    monkeypatch.setattr(token_output, "LOOKED_UP", 4000)
    monkeypatch.setattr(token_output, "LOOKED_UP_ROWS", 30)
    sizes = [(3, 10)] * 30 + [(1, 9000)] + [(10, 1)] * 7 + [(2, 700)] * 9
    given = [pa.RecordBatch.from_pydict({"doc_id": [k] * n, "text": ["x" * m] * n}) for k, (n, m) in enumerate(sizes)]
    got = list(token_output.larger(iter(given)))
    assert pa.Table.from_batches(got).to_pydict() == pa.Table.from_batches(given).to_pydict()
    assert all(b.num_rows <= 30 and (b.nbytes <= 4000 or b.num_rows == 1) for b in got) and len(got) < 14
    assert list(token_output.larger(iter([]))) == []


def test_a_reader_decompresses_only_what_it_needs(tmp_path):
    writer = token_output.ShardWriter(f"file://{tmp_path}")
    for i in range(40):
        writer.add(i if i else None, struct.pack("<I", i) * 30_000)
    name, n_docs, n_ids = writer.close()
    assert (n_docs, n_ids) == (40, 40 * 30_000)
    fs, top = token_output.file_system(f"file://{tmp_path}")
    reader = token_output.ShardReader(fs, f"{top}/{name}")
    assert len(reader.frames) > 3 and reader.docs["null"].tolist() == [1] + [0] * 39
    assert reader.ids(reader.docs[37]) == struct.pack("<I", 37) * 30_000 and reader.held[0] == reader.docs[37]["frame"]
    data = bytearray((tmp_path / name).read_bytes())
    data[100] ^= 1
    (tmp_path / "broken").write_bytes(data)
    with pytest.raises(Exception, match="checksum|decompress"):
        broken = token_output.ShardReader(fs, f"{top}/broken")
        [broken.ids(x) for x in broken.docs]
