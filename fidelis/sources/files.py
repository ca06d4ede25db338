"""Tables from globs of CSV, JSON-lines and text files, and reports written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packets as P
from ..functions.addresses import label_of_file, label_of_folder

PACKETS = "`Timestamp` double, `Src IP` string, `Dst IP` string, `Src Port` int, `Dst Port` int, `Protocol` string, `Packet Size` int, pkt_len int, TTL int, `IP ID` int, `IP Type of Service` int, `TCP Window Size` int, `TCP Data Offset` int, `TCP Flags` string"
FLOWS = "`Src IP` string, `Dst IP` string, `Src Port` int, `Dst Port` int, Protocol string, `Total Packets` bigint, `Total Bytes` bigint"
BYTE_SEQUENCES = "Data string, Hash string, Filename string, OrigLen int"
INSTRUCTIONS = "instruction string, output string"


def csv(spark: SparkSession, glob: str, schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All CSV files of a glob as one scan, with ``file``. Empty and unreadable files give no rows.

    Give a schema for large inputs: without one Spark reads the files once more to infer it.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", encoding).option("ignoreCorruptFiles", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(glob).withColumn("file", F.col("_metadata.file_path"))


def head_per_file(rows: DataFrame, order: list[str], n: int = 200) -> DataFrame:
    """The first ``n`` rows of each file in an explicit order: files have none of their own in Spark."""
    from ..operators.flows import head_per_flow

    return head_per_flow(rows, ["file"], order, n).drop("position")


def column(rows: DataFrame, name: str) -> DataFrame:
    """One column without nulls; an empty table where it is missing. The scan reads nothing else."""
    return rows.select(name).where(F.col(name).isNotNull()) if name in rows.columns else rows.sparkSession.createDataFrame([], f"`{name}` string")


def instruction_outputs(spark: SparkSession, glob: str) -> DataFrame:
    """The texts ``output`` of JSON lines."""
    return spark.read.schema(INSTRUCTIONS).json(glob).select(F.col("output").alias("text")).where("text is not null")


def generated_lines(spark: SparkSession, glob: str) -> DataFrame:
    """Lines of text files, blank ones left out."""
    return spark.read.text(glob).select(F.trim("value").alias("text")).where("text <> ''")


def header_values(texts: DataFrame, field: str) -> DataFrame:
    """value: a field of each text's header dictionary, unreadable ones left out."""
    return texts.select(P.header_value(F.col("text"), field).alias("value")).where("value is not null")


def ip_values(texts: DataFrame, field: str) -> DataFrame:
    return texts.select(P.ip_value(F.col("text"), field).alias("value")).where("value is not null")


def mac_values(texts: DataFrame, which: str) -> DataFrame:
    return texts.select(P.mac_from_payload(F.col("text"), which).alias("value")).where("value is not null")


def byte_values(sequences: DataFrame, first: int, last: int) -> DataFrame:
    """value: bytes first to last - 1 of each packet of each sequence; the first packet starts with its label."""
    each = sequences.select(F.posexplode(P.packets_of(F.col("text"))).alias("i", "packet"))
    value = F.when(F.col("i") == 0, P.byte_slice(F.col("packet"), first, last, True)).otherwise(P.byte_slice(F.col("packet"), first, last))
    return each.select(value.alias("value")).where("value <> ''")


def byte_sequences(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.schema(BYTE_SEQUENCES).json(glob).select(F.col("Data").alias("text")).where("text is not null")


def bit_rows(spark: SparkSession, glob: str, prefixes: list[str]) -> DataFrame:
    """Bit CSVs with each prefix's columns packed in one array, ordered by their numbers; ``file``, ``src_ip`` stay."""
    rows = csv(spark, glob)
    number = lambda c: int(c.rsplit("_", 1)[1])
    packed: list[Column] = []
    for p in prefixes:
        own = sorted((c for c in rows.columns if c.startswith(f"{p}_") and c.rsplit("_", 1)[1].isdigit() and c.rsplit("_", 1)[0] == p), key=number)
        packed.append(F.array(*[F.col(c).cast("tinyint") for c in own]).alias(p))
    return rows.select(*[c for c in ("file", "src_ip") if c in rows.columns], *packed)


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of ``a`` that ``b`` has, too, in the order of ``a``."""
    other = set(b.columns)
    return [c for c in a.columns if c in other]


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Joins rows with (File, Label) by base name; files without label are left out."""
    base = F.element_at(F.split("file", "/"), -1)
    return rows.withColumn("_base", base).join(labels.select(F.col("File").alias("_base"), F.col("Label").alias("label")), "_base").drop("_base")


def labelled_by_path(rows: DataFrame, by: str = "folder") -> DataFrame:
    return rows.withColumn("label", label_of_folder(F.col("file")) if by == "folder" else label_of_file(F.col("file")))


def write_report(report: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; an existing report stays unless ``overwrite``."""
    report.write.mode("overwrite" if overwrite else "ignore").parquet(path)
