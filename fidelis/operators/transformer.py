"""One fitted transformer for a table: gaps filled and categories spread to columns by what each column is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "column string, kind string, fill double, values array<string>"
_KINDS = {"boolean": "boolean", "date": "time", "timestamp": "time", "timestamp_ntz": "time", "string": "category"}


def kind_of(data_type: str) -> str:
    """number, boolean, time or category of a column by its type."""
    return "number" if data_type in ("tinyint", "smallint", "int", "bigint", "float", "double") or data_type.startswith("decimal") else _KINDS.get(data_type, "category")


def as_number(c: str, kind: str) -> Column:
    """Numbers and booleans as doubles, times as nanoseconds since 1970."""
    x = F.col(f"`{c}`")
    if kind == "time":
        return F.unix_micros(x.cast("timestamp")).cast("double") * 1000.0
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


class HyperTransformer:
    """``fit`` learns a table of one row for each column; ``transform`` applies it to any table with these columns.

    Numbers and times fill gaps by the mean, booleans by the more frequent value (false on a tie), and
    categories become a column of 0 and 1 for each value seen, in order, nulls a value of their own. A
    category that was not seen fails with ``unknown="error"`` and is 0 everywhere with "ignore". The
    fitted table can be saved and loaded, as it is a DataFrame.
    """

    def __init__(self, fitted: DataFrame | None = None):
        self.rows = [] if fitted is None else [r.asDict() for r in fitted.collect()]  # a row for each column

    def fit(self, df: DataFrame, columns: list[str] | None = None, most_values: int = 10_000) -> HyperTransformer:
        """One pass for numbers, and a count of values for categories; more than ``most_values`` of one are an error, as each is a column."""
        kinds = {c: kind_of(t) for c, t in df.dtypes if columns is None or c in columns}
        plain = {c: k for c, k in kinds.items() if k != "category"}
        fill = {}
        if plain:
            means = [(F.avg(as_number(c, k)) if k != "boolean" else F.when(F.count(c) > 0, (2 * F.sum(as_number(c, k)) > F.count(c)).cast("double"))).alias(f"f{i}") for i, (c, k) in enumerate(plain.items())]
            row = df.agg(*means).first()
            fill = {c: row[f"f{i}"] for i, c in enumerate(plain)}
        words = [c for c in kinds if kinds[c] == "category"]
        values: dict[str, list] = {c: [] for c in words}
        if words:
            pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in words])
            found = df.select(F.inline(pairs)).distinct()
            sizes = {r["column"]: r["count"] for r in found.groupBy("column").count().collect()}
            if any(n > most_values for n in sizes.values()):
                raise ValueError(f"more than {most_values} values in one of {words}")
            for r in found.collect():
                values[r["column"]].append(r["value"])
        self.rows = [{"column": c, "kind": k, "fill": fill.get(c), "values": sorted(values.get(c, []), key=lambda v: (v is None, v or ""))} for c, k in kinds.items()]
        return self

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(r["column"], r["kind"], r["fill"], r["values"]) for r in self.rows], SCHEMA)

    def transform(self, df: DataFrame, unknown: str = "error") -> DataFrame:
        """Columns in the order of the fit; the k-th value of column c becomes ``c=value`` (``c`` alone for null). Other columns are left out."""
        out = []
        for r in self.rows:
            c = r["column"]
            if r["kind"] != "category":
                out.append(F.coalesce(as_number(c, r["kind"]), F.lit(r["fill"]).cast("double")).alias(c))
                continue
            x = F.col(f"`{c}`").cast("string")
            known = F.coalesce(x.isin([v for v in r["values"] if v is not None]), F.lit(None in r["values"])) if r["values"] else F.lit(False)
            strange = F.raise_error(F.concat(F.lit(f"{c} was fitted without the value "), F.coalesce(x, F.lit("null")))).cast("double") if unknown == "error" else F.lit(0.0)
            for v in r["values"]:
                hit = x.isNull() if v is None else F.coalesce(x == v, F.lit(False))
                out.append(F.when(known, hit.cast("double")).otherwise(strange).alias(c if v is None else f"{c}={v}"))
        return df.select(*out)
