"""Records and logs: last row wins, resume, merging of parts, batches under a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key with the greatest order; a partial aggregate, so no key is gathered or sorted."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet; null keys stay pending."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def require_all(wanted: DataFrame, have: DataFrame, key: str) -> None:
    """Raises with up to three keys that are missing."""
    missing = [r[0] for r in pending(wanted.select(key).distinct(), have, key).orderBy(key).limit(3).collect()]
    if missing:
        raise LookupError(f"missing: {missing}")


def union_parts(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Parts put together by column name; a later part's row replaces an earlier one's."""
    out = parts[0].withColumn("_part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_part", F.lit(k)), allowMissingColumns=True)
    return last_wins(out, keys, F.col("_part")).drop("_part")


def batches(df: DataFrame, key: str, size: str, group: str, max_items: int, max_size: int) -> DataFrame:
    """(group, key, batch): items in order of key, split greedily by their number and their sizes' sum.

    An item larger than the budget is a batch of its own. The state runs along a group, which has to
    be a bounded piece of the work (a shard), and never the whole table.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        out, batch, n, total = [], 0, 0, 0
        for s in pdf[size]:
            if n and (n >= max_items or total + s > max_size):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + s
            out.append(batch)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "batch": out})

    g, k = df.schema[group].dataType.simpleString(), df.schema[key].dataType.simpleString()
    return df.select(group, key, size).groupBy(group).applyInPandas(split, f"{group} {g}, {key} {k}, batch int")


def parse_jsonl(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Records of JSON lines; lines cut short or not JSON, and records without any field, are left out."""
    parsed = df.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("r")).filter("r is not null").select("r.*")
    return parsed.dropna(how="all")

