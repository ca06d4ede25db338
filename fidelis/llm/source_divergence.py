"""Divergence of sources from each other and from their language, by the shares of its terms.

Plain relational: matches are exploded and counted by group, the kept vocabulary is crossed with the
groups of its language to fill in zeros, the dense table is joined with itself on language and term,
and sums are ranked. DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Terms are runs of letters of ASCII and of all characters beyond it; what is between them is the rest of ASCII.
TERM, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Parts of a language's rows that meet in different tasks.
SALTS = 64


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Texts of ASCII alone take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def terms_of(text: Column) -> Column:
    """The terms of a text, in order, and empty strings at its ends.

    The matches of TERM are the parts between matches of BETWEEN: Spark's regexp_extract_all copies the
    whole text for each match, so it takes the square of a long text's length.
    """
    return F.split(lower_ascii(text), BETWEEN)


def share(count: Column, total: Column, size: Column, prior: int, scale: int) -> Column:
    """1 + floor(scale (count + prior) / (total + prior size)), exact for counts of any table."""
    whole = (F.lit(scale).cast("decimal(11,0)") * (count + prior).cast("decimal(20,0)")).cast("decimal(32,0)")
    return F.call_function("div", whole, (total + F.lit(prior) * size).cast("decimal(32,0)")) + 1


def source_divergence(docs: DataFrame, least_docs: int = 30, prior: int = 5, scale: int = 1_000_000_000, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group of ``docs``.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps its
    terms in at least ``least_docs`` rows. A term's share in a group or language is
    1 + floor(scale (count + prior) / (N + prior V)) with N the counts' sum over the V kept terms. Part
    ``pair``: the sum over kept terms of the absolute differences from each other source (item) of the
    language, all ranks. Part ``term``: kept terms that the group has and has more often than its
    language, by the difference, up to rank ``top``. Larger values come first, ties by UTF-8 bytes.

    Null text, lang and source count as ''. Each row is a document, repeated ones and those without an
    id, too. A group without terms has zeros for all kept terms; a language without kept terms gives
    pairs of value 0. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = written(own.select("lang", "source").distinct(), "term-groups")
    once = own.select("lang", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).filter("term <> ''")
    often = once.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= least_docs)
    every = own.select("lang", "source", F.explode(terms_of(F.col("text"))).alias("term")).filter("term <> ''")
    counts = every.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("count"))
    known = written(counts.join(often.select("lang", "term"), ["lang", "term"], "left_semi"), "term-counts")

    terms = written(known.groupBy("lang", "term").agg(F.sum("count").alias("all")), "kept-terms")
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("n"))
    kept = terms.join(sizes, "lang").select("lang", "term", "v", share(F.col("all"), F.col("n"), F.col("v"), prior, scale).alias("q"))
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))

    totals = groups.join(known.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
    totals = totals.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    # Each group with the kept terms of its language: as many rows for a term as the language has sources.
    dense = totals.join(kept, ["lang", "salt"]).join(known, ["lang", "source", "term"], "left")
    dense = dense.withColumn("count", F.coalesce("count", F.lit(0)))
    dense = written(dense.select("lang", "source", "term", "count", "q", share(F.col("count"), F.col("n"), F.col("v"), prior, scale).alias("p")), "dense-shares")

    left, right = dense.select("lang", "source", "term", "p"), dense.select("lang", F.col("source").alias("item"), "term", F.col("p").alias("p2"))
    half = left.join(right, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("p2"))).alias("value"))
    # Languages without kept terms: every pair of their sources has the value 0.
    bare = groups.join(sizes.select("lang"), "lang", "left_anti").select("lang", "source", F.pmod(F.xxhash64("source"), F.lit(SALTS)).alias("salt"))
    others = bare.select("lang", F.col("source").alias("item"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    zero = bare.join(others, ["lang", "salt"]).filter("source <> item").select("lang", "source", "item", F.lit(0).cast("bigint").alias("value"))
    pairs = half.union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).union(zero)
    above = dense.filter("count > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return pairs.withColumn("rank", rank).select(*columns("pair")).union(above.withColumn("rank", rank).filter(F.col("rank") <= top).select(*columns("term")))


def divergence_sql(least_docs: int = 30, prior: int = 5, scale: int = 1_000_000_000, top: int = 50) -> str:
    """The same in SQL over the table ``documents``."""
    share = lambda count: f"1 + ({scale}::HUGEINT * ({count} + {prior})) // (n + {prior} * v)"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents),
found AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT id) AS d FROM found GROUP BY ALL),
terms AS (SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL HAVING sum(d) >= {least_docs}),
sizes AS (SELECT lang, count(*) AS v, sum(c) AS n FROM terms GROUP BY lang),
q AS (SELECT lang, term, {share("c")} AS q FROM terms JOIN sizes USING (lang)),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT g.lang, g.source, t.term, coalesce(k.c, 0) AS c, s.v FROM groups g JOIN terms t USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN counts k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term),
totals AS (SELECT lang, source, sum(c) AS n FROM dense GROUP BY ALL),
p AS (SELECT lang, source, term, c, {share("c")} AS p FROM dense JOIN totals USING (lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item,
    coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
above AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM above) WHERE rank <= {top})
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked"""
