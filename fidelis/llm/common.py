"""What the text operators share: Arrow batches of texts, the shared folder and table access.

All operators treat a null text as described in their own docstrings, mostly as empty.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes in one Arrow batch. Texts may be long, so a batch holds few of them.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Text bytes that a task works on at once; a single longer text is a group of its own.
GROUP_BYTES = 4_000_000


def prepare(spark: SparkSession) -> None:
    """Sets the size of Arrow batches for texts; called by each operator that ships texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests on one machine) a local folder takes its place.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/fidelis"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Uncompressed bytes that a task's Parquet writer gathers before it writes them.
ROW_GROUP_BYTES = 32 << 20
#: Folders with intermediate tables that this driver has made and not yet deleted.
_MADE: dict[str, None] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors.

    ``dropped`` deletes it when nothing reads it any more, ``clean`` all that are left. Spark deletes the
    shuffle files and broadcasts of the write once the driver's garbage is collected, so that is asked for here.
    """
    folder = shared_dir(df.sparkSession, name)
    _MADE[folder] = None
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(f"{folder}/table")
    df.sparkSession._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table")
    out._fidelis_folder = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` from the shared folder. Only for tables that no later read needs."""
    for df in tables:
        _delete(df.sparkSession, df._fidelis_folder)


def clean(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this driver: call it when the results have been read or stored."""
    for folder in list(_MADE):
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _MADE.pop(folder, None)


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a shared folder and the path in it, for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def map_texts(
    df: DataFrame,
    columns: list[str],
    schema: str | StructType,
    start: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]],
) -> DataFrame:
    """Runs ``start()`` once in each task; what it returns turns batches of ``columns`` into columns of ``schema``."""
    prepare(df.sparkSession)
    names = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for out in work(batch):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names)
        del work
        give_back()

    return df.select(*columns).mapInArrow(run, schema)


def text_groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have ``limit`` bytes together at most, or are one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def strings(texts: pa.Array) -> list[str]:
    return pc.fill_null(texts, "").to_pylist()


def crc_bucket(column: str, modulus: int):
    """crc32 of a column as text, modulo ``modulus``; null counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def sample_by_class(df: DataFrame, key: str, per_class: int, columns: list[str]) -> DataFrame:
    """``per_class`` rows of each value of ``key`` (all, if there are fewer), those with the least hashes of doc_id.

    Of values with many ids, only hashes below a threshold take part; it follows from the numbers of
    different ids (so repeated ids don't lower it) and lets some twice ``per_class`` of them through. So
    the rows of a value that meet in one task do not grow with the input, and only narrow columns are
    shuffled.
    """
    from pyspark.sql import Window

    rows = df.select(*dict.fromkeys([key, "doc_id", *columns])).withColumn("_h", F.xxhash64("doc_id"))
    bits = 62
    counts = rows.groupBy(key).agg(F.approx_count_distinct("doc_id", 0.02).alias("_n")).filter(F.col("_n") > 4 * per_class)
    # 2 * per_class + 200 of n ids, give or take a few hundredths, are expected below the bound: fewer than per_class would be most unlikely.
    bound = (F.lit(float(1 << bits)) * (2 * per_class + 200) / F.col("_n")).cast("bigint")
    bounds = counts.select(F.col(key).alias("_key"), bound.alias("_bound"))
    thin = rows.join(F.broadcast(bounds), F.col(key) == F.col("_key"), "left")  # a row for each value with over 4 * per_class ids
    thin = thin.filter(F.col("_bound").isNull() | (F.pmod("_h", F.lit(1 << bits)) < F.col("_bound")))
    thin = thin.select(*[c for c in rows.columns]).distinct()  # a repeated id counts once
    order = Window.partitionBy(key).orderBy(F.pmod("_h", F.lit(1 << bits)), "doc_id")
    return thin.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_class).drop("_rank", "_h")


class Memo:
    """A bounded dictionary from words to results; ``learn`` fills in those of a batch that it lacks.

    The bound holds for entries and, roughly, for bytes. Words of more than ``LONG_WORD`` characters
    (or bytes) are few, but may be as long as a text: they are forgotten with the next batch.
    """

    LONG_WORD = 64

    def __init__(self, learn: Callable[[list], list], limit: int = 500_000, most_bytes: int = 96 << 20):
        self.known: dict = {}
        self.passing: list = []
        self.learn, self.limit, self.most_bytes, self.bytes = learn, limit, most_bytes, 0

    def need(self, parts: list[list]) -> dict:
        """Results of at least all words in ``parts``, until the next call."""
        for w in self.passing:
            self.known.pop(w, None)
        self.passing = []
        words = set().union(*parts)
        new = list(words.difference(self.known))
        if new:
            if len(self.known) + len(new) > self.limit or self.bytes > self.most_bytes:
                # Only what this batch needs stays: it has the frequent words.
                each = self.bytes // max(1, len(self.known))
                self.known = {w: self.known[w] for w in words if w in self.known}
                self.bytes = each * len(self.known)
            found = self.learn(new)
            self.known.update(zip(new, found, strict=True))
            self.passing = [w for w in new if len(w) > self.LONG_WORD]
            lasting = len(new) - len(self.passing)
            self.bytes += sum(map(len, new)) - sum(map(len, self.passing)) + lasting * (160 + (getattr(found[0], "nbytes", 0) or 64))
        return self.known


def give_back() -> None:
    """Returns what a task has freed to the system: its executor's other work needs it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


#: What a Python worker keeps from task to task: one object, with its kind and parameters.
_KEPT: dict = {}


def kept(make: Callable, *args):
    """``make(*args)``, once in a worker process, until another operator keeps something."""
    key = (make.__module__, make.__qualname__, *args)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make(*args)
    return _KEPT[key]


def let_go() -> None:
    """Forgets what an operator before has kept in this worker."""
    _KEPT.clear()


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def ragged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of arrays and their offsets."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum(sizes)])
