"""Draws, folds and resampling. Randomness is the order of md5 over a seed and an id, so every draw is
the same on any cluster and in any engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.functions.expressions import order_hash


def draw(df: DataFrame, by: list[str], n: int | Column, seed: str, key: str = "item_id") -> DataFrame:
    """At most n rows of each group, in the order of the seed's hash; all rows if there are fewer."""
    w = Window.partitionBy(*by).orderBy(order_hash(F.lit(seed), F.col(key).cast("string")), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def hash_numbers(df: DataFrame, by: list[str], h: str, tie: str, name: str) -> DataFrame:
    """Adds ``name``: the row's number from 0 in its group in the order of the hex hash ``h``, then ``tie``.

    The hash's first three digits cut every group into 4096 even pieces in the same order.
    """
    df = df.withColumn("_p", F.substring(h, 1, 3))
    part = df.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    ahead = Window.partitionBy(*by or [F.lit(1)]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
    part = part.select(*by, "_p", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_o"))
    df = df.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(h, tie))).join(part, [*by, "_p"])
    return df.withColumn(name, F.col("_o") + F.col("_i") - 1).drop("_p", "_i", "_o")


def group_folds(df: DataFrame, folds: int, seed: str, group: str = "group_id", stratum: Column | None = None) -> DataFrame:
    """(group, fold): a group's dominant stratum, then turns within it in hash order. No group is split.

    The exact greedy assignment of group-stratified folds is sequential; this form keeps its two
    guarantees, whole groups and balanced strata, with aggregates and windows over pieces of a stratum.
    """
    main = strata(df, group, stratum)
    turns = hash_numbers(main.withColumn("h", order_hash(F.lit(seed), F.col(group).cast("string"))), ["stratum"], "h", group, "turn")
    return turns.select(group, (F.col("turn") % folds).cast("int").alias("fold"))


def strata(df: DataFrame, group: str = "group_id", stratum: Column | None = None) -> DataFrame:
    """(group, stratum): the stratum, by default data set and label, that most of a group's rows have."""
    s = stratum if stratum is not None else F.concat_ws("_", "dataset", F.col("y").cast("string"))
    per = df.groupBy(F.col(group).alias(group), s.alias("stratum")).agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy(group).agg(F.max_by("stratum", F.struct("k", "stratum")).alias("stratum"))


def nested_groups(df: DataFrame, folds: int, inner: int, seed: str, inner_seed: str, group: str = "group_id") -> DataFrame:
    """(group, held, role): test in the group's own fold; of the others, the first of the inner folds validates."""
    g = strata(df, group).join(group_folds(df, folds, seed, group), group).withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    test = F.col("fold") == F.col("held")
    rest = g.filter(~test).withColumn("h", order_hash(F.lit(inner_seed), F.col("held").cast("string"), F.col(group).cast("string")))
    rest = hash_numbers(rest, ["held", "stratum"], "h", group, "turn").select(group, "held", F.when(F.col("turn") % inner == 0, "validation").otherwise("train").alias("role"))
    return g.filter(test).select(group, "held", F.lit("test").alias("role")).unionByName(rest)


SQL_FOLDS = """
fold_s as (select group_id, dataset || '_' || cast(y as varchar) as stratum, count(*) as k from {source} group by all),
fold_m as (select group_id, arg_max(stratum, struct_pack(k := k, s := stratum)) as stratum from fold_s group by all),
folds as (select group_id, cast((row_number() over (partition by stratum order by md5('{seed}' || ':' || cast(group_id as varchar)), group_id) - 1) % {n} as int) as fold from fold_m)"""


# The chances that a Poisson variable of mean 1 is at most 0, 1, 2 …
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253)
PRIME = 2147483647


def bootstrap_weight(number: Column, replicate: Column) -> Column:
    """How often a replicate draws a group, given the group's number below 2^28.

    In a bootstrap of many groups the times a group is drawn are Poisson variables of mean 1. Here each
    is read off a pairwise independent hash, so no draws are made, joined or shuffled.
    """
    a = (replicate * replicate * 48271 + replicate * 16807 + 11) % PRIME
    b = (replicate * 69621 + 40692) % PRIME
    u = ((a * number + b) % PRIME) / float(PRIME)
    return sum((u >= c).cast("long") for c in POISSON)


def sql_bootstrap_weight(number: str, replicate: str) -> str:
    u = f"((({replicate} * {replicate} * 48271 + {replicate} * 16807 + 11) % {PRIME} * {number} + ({replicate} * 69621 + 40692) % {PRIME}) % {PRIME}) / {float(PRIME)!r}e0"
    return "(" + " + ".join(f"cast({u} >= {c!r}e0 as bigint)" for c in POISSON) + ")"


def group_number(*parts: Column | str) -> Column:
    """A hash of the parts below 2^28."""
    return F.conv(F.substring(order_hash(*parts), 1, 7), 16, 10).cast("long")


def hypergeometric(u: float, total: int, marked: int, drawn: int) -> int:
    """How many of ``drawn`` rows of ``total`` are among the ``marked``: the quantile u of its distribution."""
    low, high = max(0, drawn - (total - marked)), min(drawn, marked)
    if low >= high:
        return low
    mean = drawn * marked / total
    wide = 12 * (mean * (1 - marked / total)) ** 0.5 + 12
    k = np.arange(max(low, int(mean - wide)), min(high, int(mean + wide)) + 1, dtype=float)
    step = np.log((drawn - k[:-1]) * (marked - k[:-1])) - np.log((k[:-1] + 1) * (total - marked - drawn + k[:-1] + 1))
    log = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(log - log.max())
    return int(k[min(len(k) - 1, int((np.cumsum(p) / p.sum() < u).sum()))])
