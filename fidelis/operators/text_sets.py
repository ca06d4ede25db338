"""Instruction data sets from samples and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_by_class(rows: DataFrame, label: str, cap: int | None, train_share: float, seed: int) -> DataFrame:
    """Adds split (train or test): within each label, in a seeded order, ``cap`` rows at most (a sampling operator)."""
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), *rows.columns), *[F.col(c).cast("string") for c in rows.columns])
    placed = rows.withColumn("_i", F.row_number().over(order))
    if cap:
        placed = placed.where(F.col("_i") <= cap)
    sizes = placed.groupBy(label).agg(F.floor(F.count(F.lit(1)) * train_share).alias("_cut"))
    return placed.join(sizes, label).withColumn("split", F.when(F.col("_i") <= F.col("_cut"), "train").otherwise("test")).drop("_i", "_cut")


def label_index(rows: DataFrame, label: str) -> DataFrame:
    """label, index by order: as many rows as labels."""
    return rows.select(label).distinct().withColumn("index", F.row_number().over(Window.orderBy(label)) - 1)


def instructions(rows: DataFrame, template: str, data: str, output: str) -> DataFrame:
    """instruction (the template before the data) and output."""
    return rows.select(F.concat(F.lit(template), F.col(data)).alias("instruction"), F.col(output).alias("output"))


def field_questions(rows: DataFrame, questions: dict[str, str], seed: int) -> DataFrame:
    """One question a row, chosen by a seeded hash: instruction, and as output the field's call token."""
    choices = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(f"<{f}>").alias("a")) for f, q in questions.items()])
    pick = F.element_at(choices, (F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(len(questions))) + 1).cast("int"))
    return rows.select(pick["q"].alias("instruction"), pick["a"].alias("output"))


def encode_bytes(texts: DataFrame, column: str, length: int, specials: tuple[str, ...] = ("<|pkt|>", "<pad>")) -> DataFrame:
    """ids: bytes 0 to 255 as themselves, special marks behind them, unknown words -1; cut or padded to ``length``."""
    known = F.create_map(*[x for i, s in enumerate(specials) for x in (F.lit(s), F.lit(256 + i))])
    ids = F.transform(F.split(F.trim(column), r"\s+"), lambda w: F.coalesce(known[w], F.when(w.rlike(r"^\d{1,3}$") & (w.cast("int") < 256), w.cast("int")), F.lit(-1)))
    pad = F.lit(256 + specials.index("<pad>"))
    return texts.withColumn("ids", F.slice(F.concat(ids, F.array_repeat(pad, length)), 1, length))


def responses_by_label(rows: DataFrame, prompt: str, response: str) -> DataFrame:
    """label (last word but one of the prompt), responses."""
    return rows.groupBy(F.element_at(F.split(F.trim(prompt), r"\s+"), -2).alias("label")).agg(F.sort_array(F.collect_list(response)).alias("responses"))


def detection_set(samples: DataFrame, text: str, label: str, template: str, cap: int | None = None, train_share: float = 0.95, seed: int = 0) -> DataFrame:
    """instruction, output, split: packets of all labels, each asked for its label."""
    split = split_by_class(samples.select(F.col(text).alias("t"), F.col(label).alias("l")), "l", cap, train_share, seed)
    return split.select(F.concat(F.lit(template), F.col("t")).alias("instruction"), F.col("l").cast("string").alias("output"), "split")


def generation_set(samples: DataFrame, text: str, label: str, template: str, cap: int | None = None, train_share: float = 0.95, seed: int = 0) -> DataFrame:
    """instruction, output, split: each label is asked for and a packet of it is the answer; {label} in the template is replaced."""
    split = split_by_class(samples.select(F.col(text).alias("t"), F.col(label).alias("l")), "l", cap, train_share, seed)
    return split.select(F.replace(F.lit(template), F.lit("{label}"), F.col("l").cast("string")).alias("instruction"), F.col("t").alias("output"), "split")
