"""Near-duplicate documents by SimHash fingerprints and anchors of covering codes.

The 64 bits of a fingerprint are cut into three segments of 21, 21 and 22 bits. Fingerprints that
differ in four bits or fewer differ in one bit or none in at least one segment. A segment's anchors are
the words of a covering code: the Hamming code on 15 of its bits, every value on the others. Its
covering radius is R = 1, so each fingerprint has a home, the nearest anchor, at distance 1 or less. It
also visits the anchors within R plus the segment's threshold, 2, that can be the home of a fingerprint
one bit away: 13.6 or 14.6 on average, its home included. So of two fingerprints that differ in one bit
of the segment, each visits the home of the other, and comparing an anchor's residents with its
visitors misses no link.

The codes' sizes are fixed (2^19 anchors in all), so counts by anchor are bounded tables. So are the
bits that all or none of an anchor's residents have, in four cells by two bits of another segment: a
visitor that departs from them in more bits than the threshold in each cell is near no resident and
stays away. An anchor with many members is cut into tiles of bounded size. Before, its residents are compared in parts
that share one member, which connects most copies; then only members outside its largest component
meet the others. So a third of all documents in one group of copies takes no quadratic work, and no
pairs are emitted, only links that connect something new in a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, let_go, map_texts, prepare, text_groups, written
from .connected import components
from .ngram_join import by_tile

WIDTH, SEED, DISTANCE = 4, 42, 4
#: Text bytes whose shingles are counted at once (64 counters each meanwhile).
AT_ONCE = 500_000
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
#: First bit and length of each segment; CODED bits of each belong to the Hamming code.
SEGMENTS, CODED = ((0, 21), (21, 21), (42, 22)), 15
#: Residents, and visitors, of an anchor in one tile at most on average.
TILE = 2048
#: Anchors are numbered by segment, plain bits and number of the code's word.
WORD_BITS = 11
ANCHORS = len(SEGMENTS) << (WORD_BITS + 22 - CODED)
#: Cells of an anchor's residents, by two bits of the next segment.
CELLS = 4

FINGERPRINTS = "doc_id bigint, f bigint, words bigint"


# --- fingerprints ----------------------------------------------------------------------------


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of ``width`` words, in parts; of all words where they are fewer."""
    if not words:
        return
    flat, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - width + 1)]
    ends = ends[min(width, len(words)) - 1 :]
    for i in range(0, len(begins), 100_000):
        pairs = zip(begins[i : i + 100_000].tolist(), ends[i : i + 100_000].tolist(), strict=True)
        yield np.array([hashed(flat[a:b], SEED) for a, b in pairs], np.uint64)


def group_fingerprints(texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
    """Fingerprints of several texts and their numbers of words."""
    words = [(t or "").encode().translate(LOWER).split() for t in texts]
    sizes, hashes = [], []
    for w in words:
        parts = list(shingle_hashes(w))
        sizes.append(sum(map(len, parts)))
        hashes += parts
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate(hashes)
        n = np.array(sizes)[full]
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out, [len(w) for w in words]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, f (the fingerprint's bits as a signed number) and words of every row."""

    def start():
        let_go()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            texts = batch.column(1)
            for a, b in text_groups(texts, AT_ONCE):
                own = texts.slice(a, b - a).to_pylist()
                if b - a == 1 and len(own[0] or "") > AT_ONCE:  # a long text is counted in parts
                    words = own[0].encode().translate(LOWER).split()
                    found, n = np.array([_of_long(words)], np.uint64), [len(words)]
                else:
                    found, n = group_fingerprints(own)
                yield {"doc_id": batch.column(0).slice(a, b - a), "f": found.view(np.int64), "words": pa.array(n, pa.int64())}

        return work

    return map_texts(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), ["doc_id", "text"], FINGERPRINTS, start)


def _of_long(words: list[bytes]) -> int:
    n, bits = 0, np.zeros(64, np.int64)
    for part in shingle_hashes(words):
        n += len(part)
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * bits > n).tolist()))


# --- anchors ---------------------------------------------------------------------------------


def _syndromes() -> np.ndarray:
    """For each 15-bit value the exclusive or of the positions (1 to 15) of its bits: 0 for the code's words."""
    out = np.zeros(1, np.uint8)
    for k in range(CODED):
        out = np.concatenate([out, out ^ np.uint8(k + 1)])
    return out


class Covering:
    """Homes and visits of fingerprints by tables over the 15 coded bits."""

    def __init__(self):
        values, syndrome = np.arange(1 << CODED), _syndromes()
        number = np.cumsum(syndrome == 0) - 1  # of each word of the code
        flip = np.concatenate([[0], 1 << np.arange(CODED)])  # by position, 0 for none
        self.home = number[values ^ flip[syndrome]]
        #: The seven words at distance 2 of a value that is none: two bits whose positions give its syndrome.
        self.near = np.full((1 << CODED, 7), -1)
        for s in range(1, 16):
            own = np.flatnonzero(syndrome == s)
            for k, a in enumerate(a for a in range(1, 16) if a < a ^ s):
                self.near[own, k] = number[own ^ flip[a] ^ flip[a ^ s]]
        self.far = syndrome > 0

    def members(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, resident) of the home and all visits of fingerprints in each segment."""
        rows, anchors, resident, every = [], [], [], np.arange(len(f))
        for s, (shift, length) in enumerate(SEGMENTS):
            own = ((f >> np.uint64(shift)) & np.uint64((1 << length) - 1)).astype(np.int64)
            coded, plain = own & ((1 << CODED) - 1), own >> CODED
            at = np.flatnonzero(self.far[coded])
            home = self.home[coded]
            seen = [(every, plain, home), *[(every, plain ^ (1 << k), home) for k in range(length - CODED)], *[(at, plain[at], self.near[coded[at], k]) for k in range(7)]]
            for i, (row, p, c) in enumerate(seen):
                rows.append(row)
                anchors.append((s << (WORD_BITS + 22 - CODED)) | (p << WORD_BITS) | c)
                resident.append(np.full(len(row), i == 0))
        return np.concatenate(rows), np.concatenate(anchors), np.concatenate(resident)


def _map_nodes(nodes: DataFrame, columns: list[str], schema: str, start: Callable[[], Callable]) -> DataFrame:
    """Like ``map_texts``, with what is left when the rows end: ``work(None)`` comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                yield from work(batch.slice(a, 20_000))
        yield from work(None)
        del work
        give_back()

    prepare(nodes.sparkSession)
    return nodes.select(*columns).mapInArrow(run, schema)


class Residents:
    """How many residents each cell of each anchor has, and the bits that all of them (``low``) or any of them (``high``) have."""

    def __init__(self, cells: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.low, self.high = np.zeros(CELLS * ANCHORS, np.int64), np.full(CELLS * ANCHORS, ~np.uint64(0)), np.zeros(CELLS * ANCHORS, np.uint64)
        self.n[cells], self.low[cells], self.high[cells] = n, low.view(np.uint64), high.view(np.uint64)

    def __reduce__(self):  # only cells that have residents travel
        at = np.flatnonzero(self.n)
        return Residents, (at.astype(np.int32), np.minimum(self.n[at], 1 << 30).astype(np.int32), self.low[at].view(np.int64), self.high[at].view(np.int64))

    @staticmethod
    def cell(f: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """The cell of each fingerprint's anchor by two bits of the next segment."""
        shift = np.array([SEGMENTS[(s + 1) % len(SEGMENTS)][0] for s in range(len(SEGMENTS))], np.uint64)[anchors >> (WORD_BITS + 22 - CODED)]
        return anchors * CELLS + ((f >> shift) & np.uint64(CELLS - 1)).astype(np.int64)

    def fits(self, f: np.ndarray, anchors: np.ndarray, resident: np.ndarray, distance: int) -> np.ndarray:
        """Which fingerprints may be near a resident of their anchor, other than themselves."""
        own, out = np.where(resident, self.cell(f, anchors), -1), np.zeros(len(f), bool)
        for k in range(CELLS):
            at = anchors * CELLS + k
            apart = np.bitwise_count((self.low[at] & ~f) | (~self.high[at] & f))
            out |= (apart <= distance) & (self.n[at] > (at == own))
        return out

    def by_anchor(self) -> np.ndarray:
        return self.n.reshape(ANCHORS, CELLS).sum(axis=1)


def residents_of(nodes: DataFrame) -> Residents:
    def start():
        let_go()
        code = Covering()

        def work(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if batch is None:
                return
            f = batch.column(0).to_numpy()
            rows, anchors, resident = code.members(f.view(np.uint64))
            f = f[rows[resident]]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(Residents.cell(f.view(np.uint64), anchors[resident]), pa.int64()), "f": pa.array(f, pa.int64())})

        return work

    cells = _map_nodes(nodes, ["f"], "cell bigint, f bigint", start).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.bit_and("f").alias("low"), F.bit_or("f").alias("high"))
    return Residents(*(c.to_numpy() for c in cells.toArrow().columns))  # a row for each cell of the codes at most


#: Rows of ``anchor_counts``.
RESIDENTS, VISITORS, ODD_RESIDENTS, ODD_VISITORS, NEAR = range(5)


def anchor_counts(nodes: DataFrame, homes: Broadcast, tops: np.ndarray | None, distance: int) -> np.ndarray:
    """By anchor: residents, visitors that fit, both of these outside the anchor's top label, and members that fit."""
    shared = nodes.sparkSession.sparkContext.broadcast(tops)  # a number for each anchor, or None

    def start():
        let_go()
        code, known, top = Covering(), homes.value, shared.value
        counts = np.zeros(5 * ANCHORS, np.int32)

        def work(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if batch is None:
                at = np.flatnonzero(counts)
                for i in range(0, len(at), 50_000):
                    yield pa.RecordBatch.from_pydict({"cell": pa.array(at[i : i + 50_000], pa.int32()), "n": pa.array(counts[at[i : i + 50_000]], pa.int64())})
                return
            f, label = (batch.column(i).to_numpy() for i in (0, 1))
            rows, anchors, resident = code.members(f.view(np.uint64))
            fits = known.fits(f.view(np.uint64)[rows], anchors, resident, distance)
            met = resident | fits
            np.add.at(counts, (np.where(resident, RESIDENTS, VISITORS) * ANCHORS + anchors)[met], 1)
            np.add.at(counts, NEAR * ANCHORS + anchors[fits], 1)
            if top is not None:
                odd = met & (label[rows] != top[anchors])
                np.add.at(counts, (np.where(resident, ODD_RESIDENTS, ODD_VISITORS) * ANCHORS + anchors)[odd], 1)

        return work

    cells = _map_nodes(nodes, ["f", "label"], "cell int, n bigint", start).groupBy("cell").agg(F.sum("n").alias("n"))
    found = cells.toArrow()  # five numbers for each anchor of the codes at most
    out = np.zeros(5 * ANCHORS, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.reshape(5, ANCHORS)


def _cuts(n: np.ndarray, tile: int) -> np.ndarray:
    return np.maximum(1, -(-n // tile)).astype(np.int32)


def _part(f: np.ndarray, salt: int, cuts: np.ndarray) -> np.ndarray:
    """A part below ``cuts`` by a hash of the fingerprint."""
    h = (f.view(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % cuts.astype(np.uint64)).astype(np.int64)


def home_tiles(nodes: DataFrame, residents: np.ndarray, pivots: np.ndarray, tile: int) -> DataFrame:
    """Tiles of the residents of large anchors; each part of one has its smallest fingerprint, too."""
    hot = residents > tile
    shared = nodes.sparkSession.sparkContext.broadcast((np.where(hot, _cuts(residents, tile), 0).astype(np.int32), pivots))  # two numbers for each anchor

    def start():
        let_go()
        code, (cuts, pivot) = Covering(), shared.value

        def work(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if batch is None:
                return
            f = batch.column(0).to_numpy()
            rows, anchors, resident = code.members(f.view(np.uint64))
            at = np.flatnonzero(resident & (cuts[anchors] > 0))
            rows, anchors = rows[at], anchors[at]
            part = _part(f[rows], 1, cuts[anchors])
            first = np.flatnonzero(f[rows] == pivot[anchors])  # the smallest resident goes to all parts
            n = cuts[anchors[first]].astype(np.int64)
            every = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rest = np.setdiff1d(np.arange(len(rows)), first)
            rows = np.concatenate([rows[rest], np.repeat(rows[first], n)])
            place = np.concatenate([anchors[rest] + part[rest] * ANCHORS, np.repeat(anchors[first], n) + every * ANCHORS])
            for i in range(0, len(rows), 50_000):
                own = rows[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"tile": pa.array(place[i : i + 50_000], pa.int64()), "f": pa.array(f[own], pa.int64()), "label": pa.array(f[own], pa.int64()), "left": pa.array(np.ones(len(own), bool))})

        return work

    return _map_nodes(nodes, ["f"], "tile bigint, f bigint, label bigint, left boolean", start)


def member_tiles(nodes: DataFrame, homes: Broadcast, counts: np.ndarray, tops: np.ndarray | None, distance: int, tile: int) -> DataFrame:
    """Tiles in which residents (the left side) meet all members of their anchors that fit.

    Where an anchor has a top label: residents without it meet all members, those with it the members
    without it. All sides are cut into parts, and every part of the left meets every part of the right.
    """
    residents, visitors, odd_residents, odd_visitors, near = counts
    if tops is None:
        left, right = (residents,), (residents + visitors,)
    else:
        # Anchors without a top label have all members outside it.
        left, right = (odd_residents, residents - odd_residents), (residents + visitors, odd_residents + odd_visitors)
    sides = [(_cuts(a, tile), _cuts(b, 2 * tile)) for a, b in zip(left, right, strict=True)]
    meets = [(a > 0) & (b > 1 if k == 0 else b > 0) & (near > 0) for k, (a, b) in enumerate(zip(left, right, strict=True))]
    shared = nodes.sparkSession.sparkContext.broadcast((sides, meets, tops))  # a few numbers for each anchor

    def start():
        let_go()
        code, (cuts, meet, top), known = Covering(), shared.value, homes.value

        def dealt(f, rows, anchors, k, on_left):
            """Rows' tiles: each part of a side goes with every part of the other."""
            own, other = cuts[k][0 if on_left else 1][anchors], cuts[k][1 if on_left else 0][anchors].astype(np.int64)
            part = _part(f[rows], 1 + k, own)
            every = np.arange(other.sum()) - np.repeat(np.cumsum(other) - other, other)
            part, width = np.repeat(part, other), np.repeat(cuts[k][1][anchors].astype(np.int64), other)
            cell = part * width + every if on_left else every * width + part
            return np.repeat(rows, other), np.repeat(anchors, other), (cell * 2 + k) * ANCHORS + np.repeat(anchors, other)

        def work(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if batch is None:
                return
            for a in range(0, batch.num_rows, 2000):  # large anchors multiply rows
                f, label = (batch.column(i).slice(a, 2000).to_numpy() for i in (0, 1))
                rows, anchors, resident = code.members(f.view(np.uint64))
                kept = resident | known.fits(f.view(np.uint64)[rows], anchors, resident, distance)
                rows, anchors, resident = rows[kept], anchors[kept], resident[kept]
                odd = np.ones(len(rows), bool) if top is None else label[rows] != top[anchors]
                out = []
                for k in range(len(meet)):
                    met = meet[k][anchors]
                    on_left = met & resident & (odd if k == 0 else ~odd)
                    on_right = met & (odd if k == 1 else True)
                    if k == 0:
                        # Where neither side is cut, a resident's one row stands on both.
                        plain = (cuts[k][0][anchors] == 1) & (cuts[k][1][anchors] == 1)
                        on_right &= ~(on_left & plain)
                    for side, is_left in ((on_left, True), (on_right, False)):
                        at = np.flatnonzero(side)
                        own, _, place = dealt(f, rows[at], anchors[at], k, is_left)
                        out.append((own, place, np.full(len(own), is_left)))
                own, place, left = (np.concatenate(x) for x in zip(*out, strict=True))
                for i in range(0, len(own), 50_000):
                    r = own[i : i + 50_000]
                    yield pa.RecordBatch.from_pydict({"tile": pa.array(place[i : i + 50_000], pa.int64()), "f": pa.array(f[r], pa.int64()), "label": pa.array(label[r], pa.int64()), "left": pa.array(left[i : i + 50_000])})

        return work

    return _map_nodes(nodes, ["f", "label"], "tile bigint, f bigint, label bigint, left boolean", start)


# --- comparison ------------------------------------------------------------------------------


def near_pairs(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in two arrays of fingerprints of all pairs that differ in ``distance`` bits or fewer."""
    found, step = [], max(1, (1 << 18) // max(1, len(right)))
    for a in range(0, len(left), step):
        x, y = np.nonzero(np.bitwise_count(left[a : a + step, None] ^ right[None, :]) <= distance)
        found.append((x + a, y))
    return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def tile_links(tiles: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of fingerprints with different labels in all tiles, as spanning forests."""

    def work(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        f, label, left = (rows.column(i).to_numpy() for i in (1, 2, 3))
        bits, links = f.view(np.uint64), []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = np.flatnonzero(left[a:b]) + a
            if b - a < 2 or not len(own):
                continue
            x, y = near_pairs(bits[own], bits[a:b], distance)
            x, y = own[x], y + a
            new = label[x] != label[y]
            root: dict[int, int] = {}

            def find(v: int, root: dict = root) -> int:
                while root.get(v, v) != v:
                    root[v] = root.get(root[v], root[v])
                    v = root[v]
                return v

            for i, j in zip(x[new].tolist(), y[new].tolist(), strict=True):
                p, q = find(int(label[i])), find(int(label[j]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    links.append((int(f[i]), int(f[j])))
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return by_tile(tiles, ["f", "label", "left"], "a bigint, b bigint", work)


def _tops(nodes: DataFrame, hot: np.ndarray) -> np.ndarray:
    """The most frequent label of each anchor in ``hot``, a number that is no anchor's top elsewhere."""
    shared = nodes.sparkSession.sparkContext.broadcast(hot)  # a bit for each anchor

    def start():
        code, large = Covering(), shared.value

        def work(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if batch is None:
                return
            f, label = (batch.column(i).to_numpy() for i in (0, 1))
            rows, anchors, _ = code.members(f.view(np.uint64))
            at = np.flatnonzero(large[anchors])
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchors[at], pa.int64()), "label": pa.array(label[rows[at]], pa.int64())})

        return work

    seen = _map_nodes(nodes, ["f", "label"], "anchor bigint, label bigint", start).groupBy("anchor", "label").count()
    best = seen.groupBy("anchor").agg(F.max(F.struct("count", "label")).alias("m")).select("anchor", "m.label")
    found = best.toArrow()  # one row for each anchor of the codes at most
    # Other anchors get no top label: their members all count as outside it, whatever their labels.
    out = np.full(ANCHORS, np.iinfo(np.int64).min, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def _smallest(nodes: DataFrame, hot: np.ndarray) -> np.ndarray:
    """The smallest resident of each anchor in ``hot``."""
    shared = nodes.sparkSession.sparkContext.broadcast(hot)

    def start():
        code, large = Covering(), shared.value

        def work(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if batch is None:
                return
            f = batch.column(0).to_numpy()
            rows, anchors, resident = code.members(f.view(np.uint64))
            at = np.flatnonzero(resident & large[anchors])
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchors[at], pa.int64()), "f": pa.array(f[rows[at]], pa.int64())})

        return work

    found = _map_nodes(nodes, ["f"], "anchor bigint, f bigint", start).groupBy("anchor").agg(F.min("f").alias("f")).toArrow()
    out = np.zeros(ANCHORS, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def linked(nodes: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """(node, root) of the fingerprints ``nodes`` (f bigint, distinct) that have a link."""
    if not 0 <= distance < 2 * len(SEGMENTS):
        raise ValueError("the three segments find distances up to 5")
    labelled, tops, links = nodes.select("f", F.col("f").alias("label")), None, None
    homes = residents_of(nodes)
    hot = homes.by_anchor() > tile
    if hot.any():
        links = written(tile_links(home_tiles(nodes, homes.by_anchor(), _smallest(nodes, hot), tile), distance), "home-links")
        roots = components(links)
        labelled = written(nodes.join(roots, nodes["f"] == roots["node"], "left").select("f", F.coalesce("root", "f").alias("label")), "labelled")
        tops = _tops(labelled, hot)
    shared = nodes.sparkSession.sparkContext.broadcast(homes)  # three numbers for each cell of the codes at most
    counts = anchor_counts(labelled, shared, tops, distance)
    further = written(tile_links(member_tiles(labelled, shared, counts, tops, distance, tile), distance), "member-links")
    shared.destroy()
    return components(further if links is None else further.unionByName(links))


def simhash(docs: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and n_words of every row of ``docs``.

    A-Z are lower-cased, words are runs of characters other than ASCII white space, shingles have four
    of them (or all, if there are fewer) and count as often as they occur. A bit of the fingerprint is
    set if more than half of the shingles' XXH64 values (seed 42) have it. Fingerprints link when they
    differ in ``distance`` bits or fewer (5 at most); component_id is the smallest doc_id reachable.

    Texts without words, null ones too, have the fingerprint 0 and link like others. Rows with a null
    doc_id take no part in components and have a null component. Repeated rows come back as often. An
    empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    base = written(fingerprints(docs), "fingerprints")
    classes = written(base.filter("doc_id is not null").groupBy("f").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = written(linked(classes.select("f"), distance, tile), "fingerprint-roots")
    named = classes.join(roots, classes["f"] == roots["node"], "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(best, "root").select("f", "component_id")
    out = base.join(names, "f", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), own.alias("component_id"), F.col("words").alias("n_words"))
