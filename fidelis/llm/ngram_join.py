"""N-gram Jaccard join by blocked sparse products of the document by n-gram incidence.

Documents with the same set of n-grams form one class. A pair of classes at or above the threshold
shares one of its rarest n-grams: of the larger set of size n one of the first n - ceil(t n) + 1 in a
global order, of the smaller one of the first n - ceil(2 t n / (1 + t)) + 1 (its "short" part). The
order is (count in a sketch of fixed size, hash), so n-grams of many documents come last; any order
gives the same result. N-grams that the sketch has once are in one document and lead nowhere. Classes
that share such an n-gram, in the short part of one of them, with the same smallest class form a
group, and a group is cut into tiles of bounded size. In a tile the sparse incidence of documents and
the n-grams that two of them share is multiplied in blocks of columns: rare columns add their pairs,
frequent ones are multiplied as a dense panel. Overlap counts add up, and pairs whose sizes can't
reach the threshold any more are discarded. Tiles emit a spanning forest of their
links. The first round takes each class in one of its groups only, which connects most copies. In
the second, all groups with members that are not yet connected are multiplied, across tiles too, so
that no link between components is lost and no group's pairs are emitted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, give_back, let_go, map_texts, prepare, text_groups, written
from .connected import components

#: Fixed sizes: counters of the sketch, bits of the filter, parts that they are merged in, members of a tile, bits of a cell.
COUNTERS, FILTER_BITS, PARTS, TILE, CELL_BITS = 1 << 19, 1 << 25, 16, 256, 6
#: N-grams on each side of a tile (unless one set has more), and members that make a column a frequent one.
TILE_GRAMS, FREQUENT = 1 << 19, 8
CELLS = 1 << CELL_BITS
#: Sets of this size or more have histograms of so many cells instead, as few would say little of them.
LONG, FINE = 1024, 16 * CELLS
#: Keys of classes that a task remembers, so that a class gives its n-grams once a task.
SEEN = 1 << 18
#: Text bytes that are hashed at once; each takes about 50 bytes meanwhile.
AT_ONCE = 1_000_000
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * B
    x = (x ^ (x >> np.uint64(29))) * A
    return x ^ (x >> np.uint64(32))


#: Base of the words' polynomial hashes, its inverse, and a random number for each byte, modulo 2^64.
BASE = np.uint64(0x9FB21C651E98DF25)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTES = np.random.default_rng(2024).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BYTES[0x41:0x5B] = BYTES[0x61:0x7B]  # A-Z count as a-z
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    out = []
    for base in (BASE, INVERSE):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and the text that it is in; straight from the Arrow buffers.

    Long texts are hashed window by window; a window ends behind white space, so no word is cut.
    """
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # no word goes on in the next text
    up, down = _powers(min(len(data), AT_ONCE) + 1)
    hashes, places, a = [], [], 0
    while a < len(data):
        b = min(a + AT_ONCE, len(data))
        while b < len(data):
            spaces = np.flatnonzero(IS_SPACE[data[max(a, b - AT_ONCE) : b]])
            if len(spaces):
                b = max(a, b - AT_ONCE) + int(spaces[-1]) + 1
                break
            b = min(b + AT_ONCE, len(data))  # a word longer than a window
        if b - a >= len(up):
            up, down = _powers(b - a + 1)
        own = data[a:b]
        inside = ~IS_SPACE[own]
        begins = np.flatnonzero(inside & (first[a:b] | np.concatenate([[True], ~inside[:-1]])))
        ends = np.flatnonzero(inside & (first[a + 1 : b + 1] | np.concatenate([~inside[1:], [True]]))) + 1
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(BYTES[own] * up[: len(own)], out=sums[1:])
        hashes.append(mixed((sums[ends] - sums[begins]) * down[begins]))
        places.append(begins + a)
        a = b
    return np.concatenate(hashes), np.searchsorted(offsets, np.concatenate(places), side="right") - 1


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles, in one array with offsets.

    A text with fewer words has one shingle of all of them, one without words none.
    """
    word, doc = word_hashes(texts)
    n_words = np.bincount(doc, minlength=len(texts))
    code = np.full(len(word), width, np.uint64)
    for k in range(width):
        code[: len(word) - k] = mixed(code[: len(word) - k] * A + word[k:])
    begins = np.cumsum(n_words) - n_words
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    for i in np.flatnonzero((n_words > 0) & (n_words < width)).tolist():
        short = np.full(1, n_words[i], np.uint64)
        for w in word[begins[i] : begins[i] + n_words[i]]:
            short = mixed(short * A + w)
        code[begins[i]] = short[0]
    keep = np.zeros(len(word), bool)
    for a, m in zip(begins.tolist(), n.tolist(), strict=True):
        own = code[a : a + m]
        own.sort()
        keep[a : a + m] = True
        keep[a + 1 : a + m] = own[1:] != own[:-1]
    return code[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(texts)))])


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of size ``n`` must have with any partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def pair_need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def class_keys(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set from its size, sums and exclusive or of mixed hashes; -1 and 0 for the empty set.

    The first names a class as long as no other set has it with another second key.
    """
    n = np.diff(offsets)
    out, more, full = np.full(len(n), -1, np.int64), np.zeros(len(n), np.int64), np.flatnonzero(n)
    if len(full):
        m, at = mixed(flat), offsets[full]
        size = n[full].astype(np.uint64)
        key = mixed(np.add.reduceat(m, at) ^ mixed(np.bitwise_xor.reduceat(m, at) + size * B))
        out[full] = (key >> np.uint64(1)).astype(np.int64)
        more[full] = mixed(np.add.reduceat(mixed(m ^ A), at) + size).view(np.int64)
    return out, more


def histogram(own: np.ndarray) -> bytes:
    """A set's members by the first bits of their hashes: CELLS counts, or FINE for a long set, that bound any overlap.

    Empty if a count is too large; then there is no bound.
    """
    cells = FINE if len(own) >= LONG else CELLS
    counts = np.bincount((own >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells)
    return counts.astype("<u2").tobytes() if counts.max() < 65536 else b""


# --- fixed-size summaries that all tasks fill and that are merged part by part -----------------


def _merged(rows: DataFrame, dtype: str, size: int, add: bool) -> np.ndarray:
    """Sum (or bitwise or) of all tasks' arrays, given as rows (part, salt, data): fixed size, so it may go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(data, dtype)
                total[part] = x.copy() if part not in total else (np.minimum(total[part].astype(np.uint64) + x, np.iinfo(dtype).max).astype(dtype) if add else total[part] | x)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "salt": pa.array([0] * len(total), pa.int32()), "data": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    schema = "part int, salt int, data binary"
    once = rows.repartition(4 * PARTS, "part", "salt").mapInArrow(run, schema)
    twice = once.repartition(PARTS, "part").mapInArrow(run, schema)
    out = np.zeros((PARTS, size // PARTS), dtype)
    for r in twice.collect():
        out[r["part"]] = np.frombuffer(r["data"], dtype)
    return out.reshape(-1)


def _parts(values: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % 64
    return pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "salt": pa.array([salt] * PARTS, pa.int32()), "data": pa.array([x.tobytes() for x in values.reshape(PARTS, -1)], pa.binary())})


def gram_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """For each of COUNTERS hash values the number of (document, n-gram) with it, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for a, b in text_groups(batch.column(0), AT_ONCE):
                flat, _ = shingle_sets(batch.column(0).slice(a, b - a), width)
                counts += np.bincount((flat & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        yield _parts(np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32))
        give_back()

    prepare(docs.sparkSession)
    return _merged(docs.select("text").mapInArrow(run, "part int, salt int, data binary"), "uint32", COUNTERS, True)


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over column ``h`` (bigint): it only saves work, whatever it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy()):
                bits[at] = True
        packed = np.packbits(bits)
        del bits
        yield _parts(packed)
        give_back()

    return _merged(keys.select("h").mapInArrow(run, "part int, salt int, data binary"), "uint8", FILTER_BITS // 8, False)


def _bits(h: np.ndarray) -> list[np.ndarray]:
    m = mixed(h.astype(np.int64).view(np.uint64))
    return [((m >> np.uint64(s)) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for s in (0, 30)]


def _in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0 for at in _bits(h)])


# --- passes over the texts ------------------------------------------------------------------


def prefixes(docs: DataFrame, width: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """doc_id, n (size of the set), k and k2 (keys of its class), cells (its histogram), prefix, n_short.

    ``prefix`` has the rarest n-grams that decide, but for those that the sketch has once; its first
    ``n_short`` are those of the short part. Of the copies that a task sees, the first gives its
    histogram and n-grams; the others have nulls there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # COUNTERS numbers

    def start():
        counts = shared.value
        seen: set[tuple[int, int]] = set()
        let_go()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for a, b in text_groups(batch.column(1), AT_ONCE):
                flat, offsets = shingle_sets(batch.column(1).slice(a, b - a), width)
                n, ids, (k, k2) = np.diff(offsets), batch.column(0).slice(a, b - a), class_keys(flat, offsets)
                rarity = counts[(flat & np.uint64(COUNTERS - 1)).astype(np.int64)]
                traits, first, short = [], [], np.zeros(len(n), np.int64)
                lengths = zip((n - need(n, percent) + 1).tolist(), (n - pair_need(n, n, percent) + 1).tolist(), strict=True)
                for i, ((p, q), key, known) in enumerate(zip(lengths, zip(k.tolist(), k2.tolist(), strict=True), ids.is_valid().to_pylist(), strict=True)):
                    if not known or not n[i] or key in seen:
                        traits.append(None)
                        first.append(None)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    own = slice(offsets[i], offsets[i + 1])
                    traits.append(histogram(flat[own]))
                    by = np.argsort(rarity[own], kind="stable")[:p]
                    single = int((rarity[own][by] <= 1).sum())  # they come first
                    short[i] = max(0, q - single)
                    first.append(flat[own][by[single:]].view(np.int64))
                yield {"doc_id": ids, "n": n.astype(np.int64), "k": k, "k2": k2, "cells": pa.array(traits, pa.binary()), "prefix": pa.array(first, pa.list_(pa.int64())), "n_short": short}

        return work

    return map_texts(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), ["doc_id", "text"], "doc_id bigint, n bigint, k bigint, k2 bigint, cells binary, prefix array<bigint>, n_short bigint", start)


def sets_of(docs: DataFrame, width: int, classes: DataFrame) -> DataFrame:
    """k, k2 and the whole set of the ``classes``: the row with doc_id ``cls`` gives it.

    Some other classes may be there, too, and a class may be there twice if its document is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(classes.select(F.col("cls").cast("bigint").alias("h"))))  # FILTER_BITS

    def start():
        bits = shared.value
        let_go()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            kept = batch.filter(pa.array(_in_filter(bits, batch.column(0).to_numpy())))
            for a, b in text_groups(kept.column(1), AT_ONCE):
                flat, ends = shingle_sets(kept.column(1).slice(a, b - a), width)
                k, k2 = class_keys(flat, ends)
                yield {"k": k, "k2": k2, "grams": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))}

        return work

    rows = docs.filter(F.col("doc_id").isNotNull()).selectExpr("cast(doc_id as bigint) doc_id", "text")
    return map_texts(rows, ["doc_id", "text"], "k bigint, k2 bigint, grams array<bigint>", start)


# --- tiles ---------------------------------------------------------------------------------


def tile_links(key: np.ndarray, left: np.ndarray, label: np.ndarray, grams: np.ndarray, sizes: np.ndarray, percent: int, block: int = 4096) -> list[tuple[int, int]]:
    """Links that connect different labels among a tile's members, as a spanning forest.

    ``left`` marks rows of the product's left side (all rows are on its right). ``grams`` is flat. The
    incidence is held by columns: the members of each n-gram, one after the other.
    """
    by = np.argsort(grams)
    owner, fresh = np.repeat(np.arange(len(sizes)), sizes)[by], np.ones(len(by), bool)
    fresh[1:] = grams[by[1:]] != grams[by[:-1]]
    times = np.diff(np.flatnonzero(np.concatenate([fresh, [True]])))
    owner = owner[np.repeat(times > 1, times)]  # an n-gram of one member adds to no overlap
    times = times[times > 1]
    if not len(owner):
        return []
    rows, able, least = pairs_to_check(left, label, sizes, percent)
    place = np.full(len(sizes), -1)
    place[rows] = np.arange(len(rows))
    overlap = np.zeros(able.shape, np.int32)
    rest = np.bincount(owner, minlength=len(sizes))
    ends = np.concatenate([[0], np.cumsum(times)])
    for first in range(0, len(times), block):
        able &= overlap + np.minimum(rest[rows][:, None], rest[None, :]) >= least  # discards what sizes rule out
        if not able.any():
            return []
        count = times[first : first + block]
        own = owner[ends[first] : ends[first + len(count)]]
        column = np.repeat(np.arange(len(count)), count)
        often = count > FREQUENT
        if often.any():  # columns of many members: a dense panel
            panel, at = np.zeros((len(sizes), int(often.sum())), np.float32), often[column]
            panel[own[at], (np.cumsum(often) - 1)[column[at]]] = 1
            overlap += (panel[rows] @ panel.T).astype(np.int32)
        few, column = own[~often[column]], column[~often[column]]
        for step in range(1, FREQUENT):  # the others: each pair of members of a column adds 1
            same = np.flatnonzero(column[step:] == column[:-step])
            if not len(same):
                break
            for x, y in ((few[same], few[same + step]), (few[same + step], few[same])):
                hit = place[x] >= 0
                np.add.at(overlap, (place[x[hit]], y[hit]), 1)
        rest = rest - np.bincount(own, minlength=len(sizes))
    hits = np.argwhere(able & (overlap >= least))
    # Union of labels: only links that connect anything new are kept.
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for i, j in hits.tolist():
        x, y = find(int(label[rows[i]])), find(int(label[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(key[rows[i]]), int(key[j])))
    return out


def by_tile(tiles: DataFrame, columns: list[str], schema: str, work: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """Deals rows out by their tile and gives ``work`` whole tiles: a table and the bounds of tiles in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        let_go()

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches([x for x in held if x.num_rows]).combine_chunks()
            tile = rows.column(0).to_numpy()
            return work(rows, np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]])))

        for batch in batches:
            if batch.num_rows:
                tile = batch.column(0).to_numpy()
                cut = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on in the next batch
                if cut or held and held[-1].column(0)[-1].as_py() != tile[0]:
                    held.append(batch.slice(0, cut))
                    if any(x.num_rows for x in held):
                        yield done()
                    held = []
                held.append(batch.slice(cut))
        if held:
            yield done()
            held = []
        give_back()

    prepare(tiles.sparkSession)
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.select("tile", *columns).repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(run, schema)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.offsets.to_numpy(), lists.values.to_numpy()


def pairs_to_check(left: np.ndarray, label: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left rows, which pairs of them with all rows are open, and the overlap that each pair needs."""
    rows = np.flatnonzero(left)
    least = pair_need(size[rows][:, None], size[None, :], percent)
    able = (np.minimum(size[rows][:, None], size[None, :]) >= least) & (label[rows][:, None] != label[None, :])
    able &= ~(left[None, :] & (rows[:, None] >= np.arange(len(size))[None, :]))  # a pair within the left side counts once
    return rows, able, least


def plausible(tiles: DataFrame, percent: int) -> DataFrame:
    """Rows (tile, k, left, label) that have a partner in their tile by the bound of sizes and histograms.

    The overlap of two sets is at most the sum of the smaller counts of each cell, so no link is lost.
    Two long sets are compared by their finer cells, too.
    Rows: tile, k, left, label, n, cells.
    """

    def work(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        left, label, size = (rows.column(i).to_numpy() for i in (2, 3, 4))
        kept = [np.frombuffer(c, "<u2").astype(np.int32) for c in rows.column(5).to_pylist()]
        blank = np.full(CELLS, 65535, np.int32)
        cells = np.stack([c.reshape(CELLS, -1).sum(axis=1) if len(c) else blank for c in kept])
        keep = np.zeros(len(size), bool)
        members = np.diff(bounds)
        two = bounds[:-1][members == 2]
        fits = np.minimum(cells[two], cells[two + 1]).sum(axis=1) >= pair_need(size[two], size[two + 1], percent)
        fits &= (label[two] != label[two + 1]) & (left[two] | left[two + 1])
        small = [(i, i + 2) for i in two[fits].tolist()]
        large = zip(bounds[:-1][members > 2].tolist(), bounds[1:][members > 2].tolist(), strict=True)
        for a, b in [*small, *large]:
            own, able, least = pairs_to_check(left[a:b], label[a:b], size[a:b], percent)
            if not able.any():
                continue
            if b - a > 2:
                most = np.zeros(able.shape, np.int32)
                for c in range(CELLS):
                    x = cells[a:b, c]
                    most += np.minimum(x[own][:, None], x[None, :])
                able &= most >= least
            fine = np.fromiter((len(c) == FINE for c in kept[a:b]), bool, b - a)
            for i in np.flatnonzero(fine[own] & able.any(axis=1)).tolist():
                at = np.flatnonzero(able[i] & fine)
                if len(at):
                    able[i, at] = np.minimum(kept[a + own[i]], np.stack([kept[a + j] for j in at.tolist()])).sum(axis=1) >= least[i, at]
            keep[a + own[able.any(axis=1)]] = True
            keep[a:b] |= able.any(axis=0)
        tile, key = (rows.column(i).to_numpy() for i in (0, 1))
        return pa.RecordBatch.from_pydict({"tile": pa.array(tile[keep]), "k": pa.array(key[keep]), "left": pa.array(left[keep]), "label": pa.array(label[keep])})

    return by_tile(tiles, ["k", "left", "label", "n", "cells"], "tile bigint, k bigint, left boolean, label bigint", work)


def multiply(tiles: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of all tiles. Rows: tile, k, left, label, grams; a tile's rows are bounded by its making."""

    def work(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        key, left, label = (rows.column(i).to_numpy() for i in (1, 2, 3))
        offsets, flat = _flat(rows.column(4))
        links = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a > 1:
                links += tile_links(key[a:b], left[a:b], label[a:b], flat[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1]).astype(np.int64), percent)
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return by_tile(tiles, ["k", "left", "label", "grams"], "a bigint, b bigint", work)


def ngram_join(docs: DataFrame, width: int = 3, percent: int = 90, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Two documents link when 100 |intersection| >= percent |union| of their sets of ``width``-word
    shingles; component_id is the smallest doc_id reachable by links. Words are split at ASCII white
    space after lower-casing A-Z. Documents without words (null texts, too) have an empty set, link
    with nothing, and are their own component. Rows with a null doc_id take no part and have a null
    component. Repeated rows come back as often. An empty table gives no rows. N-grams are compared
    by 64-bit hashes, sets by 127 bits. Other columns of ``docs`` are ignored, whatever their names.
    """
    base = written(prefixes(docs, width, percent, gram_sketch(docs, width)), "prefixes")
    classes = written(_classes(base), "classes")
    twice = classes.filter("low <> high").select("k", F.lit(True).alias("twice"))
    own_keys = lambda df: df.drop("k2")
    if not twice.isEmpty():  # different sets with the same first key get new ones from both keys
        twice = written(twice, "keys-met-twice")
        fresh = F.pmod(F.xxhash64("k", "k2"), F.lit(1 << 62))
        own_keys = lambda df: df.join(twice, "k", "left").withColumn("k", F.when(F.col("twice"), fresh).otherwise(F.col("k"))).drop("k2", "twice")
        base = written(own_keys(base).withColumn("k2", F.lit(0).cast("bigint")), "prefixes")
        classes = written(_classes(base), "classes")
    classes = classes.select("k", "cls")
    leaders = base.filter("prefix is not null")  # each class in a few rows
    # N-grams of one class, or of no short part, go first. Then each n-gram falls apart by classes of
    # sizes: sizes that may link are in the same one or in neighbours. The bucket of a class of sizes has
    # its own sets and the short parts of the next smaller ones.
    inc = leaders.select("k", size_class("n", percent).cast("int").alias("size"), "n_short", F.posexplode("prefix").alias("i", "g"))
    inc = inc.select("k", "g", "size", (F.col("i") < F.col("n_short")).alias("short"))
    shared = inc.groupBy("g").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.max("short").alias("short")).filter("low <> high and short").select("g")
    near = written(inc.join(shared, "g", "left_semi"), "shared-grams")
    in_bucket = F.xxhash64("g", "size")
    parts = near.select("k", "short", F.explode(F.when(F.col("short"), F.array(in_bucket, F.xxhash64("g", F.col("size") + 1))).otherwise(F.array(in_bucket))).alias("b"))
    buckets = parts.groupBy("b").agg(F.min("k").alias("pivot"), F.max("k").alias("other"), F.max("short").alias("short")).filter("pivot <> other and short").select("b", "pivot")
    members = written(parts.join(buckets, "b").groupBy("pivot", "k").agg(F.max("short").alias("short")), "members")  # each pivot is a member, too
    dropped(near)
    traits = written(leaders.groupBy("k").agg(F.max("n").alias("n"), F.max("cells").alias("cells")), "traits")

    # Round one: each class in its first group, each part of a group with its pivot.
    once = members.groupBy("k").agg(F.min("pivot").alias("pivot")).join(traits.select("k", "n"), "k")
    groups = once.groupBy("pivot").agg(_cuts(tile))
    inside = once.filter("k <> pivot").join(groups, "pivot").select("pivot", "k", F.expr("pmod(xxhash64(k), cuts)").alias("cut"))
    pivots = groups.select("pivot", F.col("pivot").alias("k"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)).alias("cut"))
    rows = inside.unionByName(pivots).select(F.xxhash64("pivot", "cut").alias("tile"), "k", F.lit(True).alias("left"), F.col("k").alias("label"))
    open_ = written(plausible(rows.join(traits, "k"), percent), "plausible")
    grams = written(own_keys(sets_of(docs, width, classes.join(open_.select("k").distinct(), "k", "left_semi"))), "grams")
    links = written(multiply(open_.join(grams, "k"), percent), "tile-links")
    dropped(open_)
    roots = written(components(links), "roots")

    # Round two: all groups whose members aren't all connected.
    wide = members.join(traits.select("k", "n"), "k").join(roots.select(F.col("node").alias("k"), "root"), "k", "left")
    wide = written(wide.select("pivot", "k", "n", "short", F.coalesce("root", "k").alias("label")), "wide")
    dropped(members)
    across = _across(wide, percent, tile)
    if across is not None:
        more = written(plausible(across.join(traits, "k"), percent), "plausible")
        missing = classes.join(more.select("k").distinct(), "k", "left_semi").join(grams, "k", "left_anti")
        tables = [grams]
        if not missing.isEmpty():
            tables.append(written(own_keys(sets_of(docs, width, missing)), "grams"))
        every = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
        further = written(multiply(more.join(every, "k"), percent), "tile-links")
        dropped(more, *tables)
        roots = written(components(links.unionByName(further)), "roots")
        dropped(further)
    else:
        dropped(grams)
    dropped(links, wide, traits)

    found = classes.join(roots.select(F.col("node").alias("k"), "root"), "k", "left").select("k", "cls", F.coalesce("root", "k").alias("root"))
    least = found.groupBy("root").agg(F.min("cls").alias("component_id"))
    named_classes = found.join(least, "root").select("k", "component_id")
    out = base.select("doc_id", "n", "k").join(named_classes, "k", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint")).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _classes(base: DataFrame) -> DataFrame:
    """k, cls (the smallest doc_id) and the range of second keys of each class."""
    sets = base.filter("n > 0 and doc_id is not null")
    return sets.groupBy("k").agg(F.min("doc_id").alias("cls"), F.min("k2").alias("low"), F.max("k2").alias("high"))


def _cuts(tile: int, name: str = "cuts") -> Column:
    """Parts of a group, so that each has about ``tile`` members and TILE_GRAMS n-grams at most."""
    return F.greatest(F.expr(f"(count(1) + {tile - 1}) div {tile}"), F.expr(f"(sum(n) + {TILE_GRAMS - 1}) div {TILE_GRAMS}")).alias(name)


def size_class(n: str, percent: int) -> Column:
    """Number of a step on a logarithmic scale: sizes that may link are at most one step apart."""
    step = math.log(100 / percent) * 1.000001 if percent < 100 else math.log(2)
    return F.floor(F.log(n) / step)


def _across(wide: DataFrame, percent: int, tile: int) -> DataFrame | None:
    """Tiles for the pairs of a group with different labels, at least one of them in its short part; None if there are none.

    Members outside the group's largest component and with a short part meet all others; those without
    one meet the short parts of the largest component. They meet only in their own and the neighbouring
    classes of size (steps of the threshold), block by block.
    """
    parts = wide.groupBy("pivot", "label").count()
    top = parts.groupBy("pivot").agg(F.max_by("label", F.struct("count", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("pivot", "top")
    if top.isEmpty():
        return None
    salts = 16  # a large group's rows go to so many tasks
    salted = wide.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(salts)))
    top = top.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    open_ = written(salted.join(top, ["pivot", "salt"]).withColumn("size", size_class("n", percent)).drop("salt"), "open-groups")
    rest = F.col("label") != F.col("top")
    tiles = _blocks(open_.filter(rest & F.col("short")), open_, tile, 0).unionByName(_blocks(open_.filter(rest & ~F.col("short")), open_.filter(~rest & F.col("short")), tile, 1))
    return tiles.groupBy("tile", "k", "label").agg(F.max("left").alias("left"))


def _blocks(left: DataFrame, right: DataFrame, tile: int, part: int) -> DataFrame:
    """(tile, k, left, label): every block of ``left`` with every block of ``right`` in the same group and a class of size that may link."""
    every = right.groupBy("pivot", "size").agg(_cuts(tile))
    few = left.groupBy("pivot", F.col("size").alias("rest_size")).agg(_cuts(tile, "rest_cuts"))
    meets = every.withColumn("rest_size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).join(few, ["pivot", "rest_size"])
    one = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    name = F.xxhash64("pivot", "size", "cut", "rest_size", "rest_cut", F.lit(part)).alias("tile")
    right = right.join(meets, ["pivot", "size"]).select("k", "label", "pivot", "size", F.expr("pmod(xxhash64(k), cuts)").alias("cut"), "rest_size", one("rest_cuts").alias("rest_cut"))
    left = left.withColumnRenamed("size", "rest_size").join(meets, ["pivot", "rest_size"]).select("k", "label", "pivot", "size", one("cuts").alias("cut"), "rest_size", F.expr("pmod(xxhash64(k, 1), rest_cuts)").alias("rest_cut"))
    return left.select(name, "k", F.lit(True).alias("left"), "label").union(right.select(name, "k", F.lit(False).alias("left"), "label"))
