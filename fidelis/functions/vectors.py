"""Word vectors of categorical columns: rows are sentences, values are words; decoding takes the nearest vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType


def train(rows: DataFrame, columns: list[str], size: int = 10, seed: int = 0, window: int = 5) -> DataFrame:
    """word, kind, vector: one vector for each value of the columns, which learns from the values beside it in a row.

    Words are prefixed by their column, so equal values of two columns differ. Nulls are left out. The
    learner keeps all words in the driver's memory and so wants columns of few values.
    """
    word = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
    sentences = rows.select(F.array_compact(F.array(*map(word, columns))).alias("sentence"))
    model = Word2Vec(vectorSize=size, minCount=1, windowSize=window, seed=seed, inputCol="sentence", outputCol="_v", maxIter=1).fit(sentences)
    kind, value = F.substring_index("word", "=", 1), F.expr("substring(word, locate('=', word) + 1)")
    return model.getVectors().select(kind.alias("kind"), value.alias("word"), F.expr("vector").alias("vector"))


def encode(rows: DataFrame, column: str, vectors: DataFrame, name: str = "vector") -> DataFrame:
    """Adds the vector of a column's value. A number that was not learned takes that of the numerically nearest one (the smaller of two), other unknown words null."""
    own = vectors.where(F.col("kind") == column).select("word", "vector")
    known = own.select(F.col("word").cast("bigint").alias("n")).where("n is not null").agg(F.sort_array(F.collect_list("n")).alias("_known")) if _numeric(rows, column) else None
    values = rows.select(F.col(column).cast("string").alias("word")).where("word is not null").distinct()
    if known is not None:  # the learner's words are few
        missing = values.join(own, "word", "left_anti").join(F.broadcast(known))
        best = F.array_min(F.transform("_known", lambda n: F.struct(F.abs(n - F.col("word").cast("bigint")).alias("d"), n.alias("n"))))
        near = missing.select("word", best["n"].cast("string").alias("as")).join(own.withColumnRenamed("word", "as"), "as").select("word", "vector")
        own = own.unionByName(near)
    return rows.withColumn("word", F.col(column).cast("string")).join(own.withColumnRenamed("vector", name), "word", "left").drop("word")


def _numeric(rows: DataFrame, column: str) -> bool:
    return dict(rows.dtypes)[column] in ("bigint", "int", "smallint", "tinyint")


def decode(rows: DataFrame, column: str, vectors: DataFrame, kind: str, name: str = "word") -> DataFrame:
    """Adds the word whose vector has the smallest angle to a row's (ties by word); null vectors give null.

    The words' matrix is as large as the learner's own and goes to all tasks; batches are multiplied with it.
    """
    table = sorted((r["word"], r["vector"].toArray()) for r in vectors.where(F.col("kind") == kind).collect())
    words = np.array([w for w, _ in table], object)
    matrix = np.stack([v for _, v in table]) if table else np.zeros((0, 1))
    shared = rows.sparkSession.sparkContext.broadcast((words, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)))
    schema = StructType([*rows.schema.fields, StructField(name, StringType())])
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = shared.value
        for batch in batches:
            given = batch.column(at).to_pylist()
            have = [i for i, v in enumerate(given) if v is not None]
            out: list = [None] * len(given)
            for a in range(0, len(have), 1000):
                part = have[a : a + 1000]
                if len(names):
                    best = (np.array([given[i] for i in part], float) @ unit.T).round(12).argmax(axis=1)
                    for i, k in zip(part, best.tolist(), strict=True):
                        out[i] = names[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


# --- nearest words by a forest of random splits ------------------------------------------------


#: Words of one leaf that a task compares at once; larger leaves are cut into chunks of about so many.
LEAF_WORDS = 4096
#: Bytes of vectors in one partition of the leaves.
PART_BYTES = 64 << 20


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(lists), -1)


def _leaves(df: DataFrame, vector: str, planes: np.ndarray, probes: int) -> DataFrame:
    """``df`` with _cell: one row for the leaf of each tree, and ``probes`` more for the leaves behind the splits that a vector is closest to."""
    trees, depth, _ = planes.shape
    at = df.columns.index(vector)
    powers = 1 << np.arange(depth - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                x = _matrix(part.column(at))
                cells = np.empty((len(x), trees, 1 + probes), np.int64)
                for t in range(trees):
                    margins = x @ planes[t].T
                    own = (margins > 0) @ powers
                    near = np.argsort(np.abs(margins), axis=1, kind="stable")[:, :probes]
                    cells[:, t] = (t << 40) + np.column_stack([own, own[:, None] ^ powers[near]])
                told = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * trees * (1 + probes)), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, told], [*batch.schema.names, "_cells"])

    wide = df.mapInArrow(run, StructType([*df.schema.fields, StructField("_cells", ArrayType(LongType()))]))
    return wide.select(*df.columns, F.explode("_cells").alias("_cell"))


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (cell, chunk, side, word), words first: id, word, cosine of each row's best word in its leaf, the first of equal ones."""
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    key, words, vectors = None, [], []
    for batch in batches:
        cell, chunk, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        x = unit(_matrix(batch.column(5))) if batch.num_rows else None
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(chunk) != 0) | (np.diff(side) != 0)) + 1
        ends = [0, *cuts.tolist(), batch.num_rows] if batch.num_rows else [0]
        ids, best, cosines = [], [], []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if (cell[a], chunk[a]) != key:
                key, words, vectors = (cell[a], chunk[a]), [], []
            if not side[a]:
                words.append(batch.column(4).slice(a, b - a))
                vectors.append(x[a:b])
            elif words:
                if len(words) > 1:
                    words, vectors = [pa.concat_arrays(words)], [np.concatenate(vectors)]
                for c in range(a, b, 1000):
                    cos = (x[c : min(b, c + 1000)] @ vectors[0].T).round(12)
                    first = np.where(np.isnan(cos), -np.inf, cos).argmax(axis=1)
                    ids.append(batch.column(3).slice(c, len(first)))
                    best.append(words[0].take(pa.array(first)))
                    cosines.append(cos[np.arange(len(first)), first])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(best), pa.array(np.concatenate(cosines))], ["id", "word", "cosine"])


def nearest_words(rows: DataFrame, words: DataFrame, trees: int = 12, probes: int = 2, leaf: int = 64, seed: int = 0, most: int = LEAF_WORDS) -> DataFrame:
    """id, word, cosine: for each row (id, vector) the word (word, vector) with the smallest angle among those that share a leaf with it.

    A forest of random hyperplane splits cuts the words into leaves of about ``leaf`` words; a row visits
    its own leaf of each tree and those behind the ``probes`` splits that it is closest to. Rows and
    words meet in their leaves by one shuffle and a sort, where the angles are exact, ties by word; a
    leaf hands on the best word of each of its rows only, no pairs. Leaves with more than ``most`` words are
    cut into chunks that each of their rows visits. So neither side is gathered or broadcast. A vector
    without length or a null one has no word, nor has a row whose leaves are empty.
    """
    size = F.sqrt(_dot(F.col("_v"), F.col("_v")))
    given = lambda df, key: df.select(F.col(key), F.transform("vector", lambda x: x.cast("double")).alias("_v")).where(size > 0)
    own, known = given(rows, "id"), given(words, "word")
    first = known.select(F.size("_v").alias("d")).first()
    if first is None:
        return own.select("id", F.lit(None).cast("string").alias("word"), F.lit(None).cast("double").alias("cosine")).limit(0)
    n = known.count()
    depth = min(40, max(0, (max(1, n) // leaf).bit_length()))
    planes = np.random.default_rng(seed).normal(size=(trees, depth, first["d"]))
    probes = min(probes, depth)
    visits, leaves = _leaves(own, "_v", planes, probes), _leaves(known, "_v", planes, 0)
    # Chunks of the leaves with too many words: a row for each such leaf.
    large = F.broadcast(leaves.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_cell", F.ceil(F.col("_n") / most).alias("_chunks")))
    chunks = F.coalesce("_chunks", F.lit(1).cast("bigint"))
    kind = dict(own.dtypes)["id"]
    visits = visits.join(large, "_cell", "left").select("_cell", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("_chunk"), F.lit(1).alias("_side"), "id", F.lit(None).cast("string").alias("word"), "_v")
    leaves = leaves.join(large, "_cell", "left").select("_cell", F.pmod(F.xxhash64("word"), chunks).alias("_chunk"), F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("id"), "word", "_v")
    vectors = (own.count() * (1 + probes) + n) * trees
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), vectors * first["d"] * 8 // PART_BYTES)
    met = leaves.unionByName(visits).repartition(parts, "_cell", "_chunk").sortWithinPartitions("_cell", "_chunk", "_side", "word")
    schema = StructType([own.schema["id"], StructField("word", StringType()), StructField("cosine", DoubleType())])
    best = met.mapInArrow(_best, schema).groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "word")).alias("_b"))
    return best.select("id", F.col("_b.word").alias("word"), (-F.col("_b.c")).alias("cosine"))
