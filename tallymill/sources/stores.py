"""Sinks: shards, wide predictions, CSV summaries, provenance, and a store of fits.

Spark's commit protocol gives what hand-written temporary files and renames would: a reader sees a
whole write or none of it.
"""

from __future__ import annotations

import json
import platform
import subprocess
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.records import parse_jsonl


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A document of JSON that spans lines, or one per line; the schema is read from it unless given."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Replace a small result by another: readers see the old one or the new one, whole."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of an append-only log; lines that are cut short are skipped."""
    return parse_jsonl(spark.read.text(path), schema)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_shards(df: DataFrame, path: str, by: list[str], rows: int = 100_000) -> None:
    """Appends columnar shards of at most ``rows`` rows, in folders by ``by``: scans prune to what they need."""
    df.write.mode("append").option("maxRecordsPerFile", rows).partitionBy(*by).parquet(path)


def write_wide(df: DataFrame, path: str, methods: list[str]) -> None:
    """Long predictions as one row per item with a column per method."""
    p = df.groupBy("run", "seed", "item_id", "dataset", "y").pivot("method", methods).agg(F.max("score").alias("scores"), F.max("pred").alias("preds"))
    p.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small summary as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def provenance(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """One row about this run: time, versions, commit (if any) and the configuration as JSON."""
    try:
        sha = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=False).stdout.strip()
    except OSError:
        sha = ""
    row = (datetime.now(UTC).isoformat(), spark.version, platform.python_version(), sha, json.dumps(config, sort_keys=True))
    return spark.createDataFrame([row], "taken_at string, spark string, python string, commit string, config string")


class OofStore:
    """Out-of-fold scores and decisions of a block's model, with those of every other block.

    The layout is that of ``predictions`` (run, source, seed, fold, item_id, dataset, group_id, y,
    method, score, pred, threshold), so that every query on predictions reads them too. A block that is
    saved again for a run, seed and method replaces what was there.
    """

    COLUMNS = ("run", "source", "seed", "fold", "item_id", "dataset", "group_id", "y", "method", "score", "pred", "threshold")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, oof: DataFrame, run: str, seed: int, method: str, source: str = "block") -> None:
        rows = oof.withColumns({"run": F.lit(run), "seed": F.lit(seed), "method": F.lit(method), "source": F.lit(source)})
        rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in self.COLUMNS])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "seed", "method").parquet(self.path)

    def load(self, run: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path).select(*self.COLUMNS)
        return df if run is None else df.filter(F.col("run") == run)


class FitStore:
    """Finished fits, kept by the fingerprint of their rows, the fold and a hash of the parameters."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @staticmethod
    def fingerprint(rows: DataFrame) -> str:
        """Of ids and labels, whatever their order: a sum of hashes, so no group is gathered."""
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.expr("sum(cast(xxhash64(item_id, y) as decimal(38, 0)))").alias("h")).first()
        return f"{r['n']}-{r['h']}"

    def save(self, fingerprint: str, fold: int, params: dict[str, Any], record: dict[str, Any]) -> None:
        row = [(fingerprint, fold, json.dumps(params, sort_keys=True), json.dumps(record))]
        df = self.spark.createDataFrame(row, "fingerprint string, fold int, params string, record string")
        df.withColumn("params_hash", F.sha2("params", 256)).coalesce(1).write.mode("append").partitionBy("fingerprint").parquet(self.path)

    def load(self, fingerprint: str) -> DataFrame | None:
        """Records of this fingerprint, None if there are none or the store can't be read."""
        try:
            df = self.spark.read.parquet(self.path).filter(F.col("fingerprint") == fingerprint)
            return df if df.limit(1).count() else None
        except Exception:
            return None
