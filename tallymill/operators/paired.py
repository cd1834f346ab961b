"""Pairs of methods on the same items, and tests on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def method_pairs(df: DataFrame, keys: list[str], fields: list[str], ordered: bool = False) -> DataFrame:
    """(keys…, a, b) with a and b structs of method and fields, for methods on the same item.

    Each item's few methods are gathered once and paired inside the row, so the table is shuffled
    once, where a self join would shuffle both sides. ``ordered`` gives both orders of each pair.
    """
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("method", *fields))).alias("m"))
    if ordered:
        both = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y["method"] != x["method"]), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    else:
        both = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y["method"] > x["method"]), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return rows.select(*keys, F.explode(both).alias("p")).select(*keys, "p.a", "p.b")


# Coefficients of a Chebyshev fit of erfc with a relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0."""
    t = 1.0 / (1.0 + 0.5 * x)
    p: Column = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        p = F.lit(c) + t * p
    return t * F.exp(-x * x + p)


def sql_erfc(x: str) -> str:
    t = f"(1e0 / (1e0 + 0.5e0 * {x}))"
    p = f"{ERFC[-1]}e0"
    for c in reversed(ERFC[:-1]):
        p = f"({c}e0 + {t} * {p})"
    return f"({t} * exp(-({x}) * ({x}) + {p}))"


def mcnemar_statistic(b: Column, c: Column) -> Column:
    """With continuity correction; null below 25 discordant rows, where the exact test holds."""
    n = (b + c).cast("double")
    return F.when(n >= 25, (F.abs(b - c).cast("double") - 1) * (F.abs(b - c).cast("double") - 1) / n)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided: exact binomial below 25 discordant rows, else chi-square with one degree of freedom."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    tail = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k, F.lit(0))),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda acc, i: F.struct(F.when(i == 0, F.lit(1.0)).otherwise(acc["t"] * (n - i + 1) / F.greatest(i, F.lit(1))).alias("t"), (acc["s"] + F.when(i == 0, F.lit(1.0)).otherwise(acc["t"] * (n - i + 1) / F.greatest(i, F.lit(1)))).alias("s")),
        lambda acc: acc["s"],
    )
    return F.when(n == 0, 1.0).when(n < 25, F.least(F.lit(1.0), 2.0 * tail * F.pow(F.lit(0.5), n))).otherwise(erfc(F.sqrt(mcnemar_statistic(b, c) / 2.0)))


def sql_mcnemar_p(b: str, c: str) -> str:
    n = f"cast({b} + {c} as double)"
    tail = f"list_sum(list_transform(range(0, least({b}, {c}) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1e0) - lgamma({n} - i + 1))))"
    stat = f"power(abs({b} - {c}) - 1e0, 2) / {n}"
    return f"case when {b} + {c} = 0 then 1e0 when {b} + {c} < 25 then least(1e0, 2e0 * {tail} * power(0.5e0, {n})) else {sql_erfc(f'sqrt(({stat}) / 2e0)')} end"


def holm(df: DataFrame, by: list[str], p: str, name: list[str]) -> DataFrame:
    """Adds ``p_adjusted``: step-down with a running maximum, at most 1; equal p in the order of names."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    order = w.orderBy(p, *name)
    ranked = df.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(w))
    step = (F.col("_n") - F.col("_k") + 1) * F.col(p)
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_k", "_n")
