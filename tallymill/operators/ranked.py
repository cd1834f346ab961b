"""Ranks and running totals within groups that may be very large.

A group's order is cut into pieces at approximate quantiles. Windows run within a piece; the pieces'
totals, a small table, are added as offsets. No group has to pass through one task, whatever its share
of the rows. Rows are brought to distinct values first, so ties take one row, and the distinct values are
written once: the source is scanned once however many branches read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.functions.expressions import mcc
from tallymill.session import cut

PIECES = 32


def distinct_scores(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """(by…, s, pos, neg): rows of each label at each score; null scores and labels are left out."""
    rows = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*by, F.col(score).alias("s")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg")
    )


def score_cells(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """``distinct_scores`` as a table. Of scopes, data sets are counted first and added up by scope."""
    if "scope" in by and "scope" not in df.columns:
        rest = [c for c in by if c != "scope"]
        cells = scoped(distinct_scores(df, ["dataset", *rest], score, y)).groupBy(*by, "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    else:
        cells = distinct_scores(df, by, score, y)
    return cut(cells, "scores")


def running(df: DataFrame, by: list[str], order: str, sums: dict[str, str], pieces: int = PIECES, totals: dict[str, str] | None = None, previous: str | None = None) -> DataFrame:
    """Adds, for every column in ``sums``, the total over rows of the group with a smaller ``order``.

    ``sums`` maps a new column to the summed one. ``order`` is numeric and distinct within a group.
    ``totals`` maps new columns to those summed over the whole group; ``previous`` names the next
    smaller ``order``, null for the smallest. ``df`` is read three times and should be a table.
    """
    totals = totals or {}
    one = by or ["_one"]
    df = df if by else df.withColumn("_one", F.lit(1))
    grid = F.array(*[F.lit(k / pieces) for k in range(1, pieces)])
    cuts = df.groupBy(*one).agg(F.percentile_approx(order, grid, 1000).alias("_cuts"))
    df = df.join(cuts, one).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    used = list(dict.fromkeys([*sums.values(), *totals.values()]))
    part = df.groupBy(*one, "_piece").agg(F.max(order).alias("_last"), *[F.sum(c).alias(f"_t_{c}") for c in used])
    ahead = Window.partitionBy(*one).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*one)  # a row per piece
    part = part.select(
        *one, "_piece", F.max("_last").over(ahead).alias("_before"), *[F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_o_{n}") for n, c in sums.items()],
        *[F.sum(f"_t_{c}").over(every).alias(n) for n, c in totals.items()],
    )
    inside = Window.partitionBy(*one, "_piece").orderBy(order)
    below = inside.rowsBetween(Window.unboundedPreceding, -1)
    df = df.select("*", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"_i_{n}") for n, c in sums.items()], *([F.lag(order).over(inside).alias("_prev")] if previous else []))
    df = df.join(part, [*one, "_piece"])
    keep = [c for c in df.columns if not c.startswith("_")]
    return df.select(*keep, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums], *([F.coalesce("_prev", "_before").alias(previous)] if previous else []))


def average_ranks(df: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """(by…, value, avg_rank, n_ties) of distinct values: ties share the mean of their ranks."""
    counts = cut(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_ties")), "values")
    ranked = running(counts, by, value, {"below": "n_ties"})
    return ranked.select(*by, value, (F.col("below") + (F.col("n_ties") + 1) / 2.0).alias("avg_rank"), "n_ties")


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], weight: str | None = None) -> DataFrame:
    """(by…, cuts): exact percentiles with linear interpolation, of groups of any size.

    ``percentile`` keeps all distinct values of a group in one task's memory; here the two values next
    to each place are found from running counts. ``weight`` is a column of row counts, 1 without it.
    """
    w = F.sum(weight) if weight else F.count(F.lit(1))
    counts = cut(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v_")).agg(w.alias("n_")).filter("n_ > 0"), "values")
    d = running(counts, by, "v_", {"below_": "n_"}, totals={"total_": "n_"}).withColumn("end_", F.col("below_") + F.col("n_"))
    # The places that fall on a value: few rows in all, two for each share and group.
    at = lambda p: p * (F.col("total_") - 1)
    hit = lambda i: (F.col("below_") <= i) & (i < F.col("end_"))
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(shares)])
    met = F.filter(grid, lambda g: hit(F.floor(at(g["p"]))) | hit(F.ceil(at(g["p"]))))
    d = d.select(*by, "v_", "below_", "end_", "total_", F.explode(met).alias("met_"))
    place = at(F.col("met_.p"))
    d = d.groupBy(*by, F.col("met_.k").alias("k_")).agg(
        F.max(F.when(hit(F.floor(place)), F.col("v_"))).alias("l_"), F.max(F.when(hit(F.ceil(place)), F.col("v_"))).alias("h_"), F.max(place - F.floor(place)).alias("f_")
    )
    cuts = F.array_sort(F.collect_list(F.struct("k_", (F.col("l_") + (F.col("h_") - F.col("l_")) * F.col("f_")).alias("c"))))
    return d.groupBy(*by).agg(F.transform(cuts, lambda c: c["c"]).alias("cuts"))


def held_out_grid(df: DataFrame, by: list[str], value: str, sums: dict[str, Column], grid: list[float]) -> DataFrame:
    """(by…, held, k, t, n, n_below, total_…, below_…): for each fold and grid point, the quantile t of the
    other folds' values, their rows, and every sum over all of them and over those below t.

    A row per distinct value holds the counts of every fold; the held fold's are taken off running
    totals, so no row is copied per fold. Null values are left out. Folds are few.
    """
    cells = df.filter(F.col(value).isNotNull()).groupBy(*by, "fold", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(k) for k, c in sums.items()])
    cells = cut(cells, "cells")
    folds = sorted(r[0] for r in cells.select("fold").distinct().collect())
    names = ["n", *sums]
    own = {f: {c: f"{c}__{k}" for c in names} for k, f in enumerate(folds)}
    every = [F.sum(c).alias(f"{c}__all") for c in names]
    wide = cells.groupBy(*by, "v").agg(*every, *[F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c))), F.lit(0)).alias(own[f][c]) for f in folds for c in names])
    wide = cut(wide, "values")
    cols = [f"{c}__all" for c in names] + [x for f in folds for x in own[f].values()]
    run = running(wide, by, "v", {f"b_{c}": c for c in cols}, totals={f"t_{c}": c for c in cols})

    def without(f: object) -> Column:
        less = lambda p, c: F.col(f"{p}{c}__all") - F.col(f"{p}{own[f][c]}")
        inside = [less("", "n").alias("w"), F.col(f"t_{own[f]['n']}").alias("mine")]
        return F.struct(F.lit(f).alias("held"), *inside, *[less("t_", c).alias(f"total_{c}") for c in names], *[less("b_", c).alias(f"below_{c}") for c in names])

    g = F.array(*[F.lit(float(x)) for x in grid])
    step = (grid[-1] - grid[0]) / max(1, len(grid) - 1)
    rows = run.select(*by, "v", F.explode(F.array(*[without(f) for f in folds])).alias("h")).select(*by, "v", "h.*").filter("w > 0 and mine > 0")
    # The grid points next to the value's place by an even grid, then exactly.
    at = lambda n: (n / F.greatest(F.col("total_n") - 1, F.lit(1)) - grid[0]) / (step or 1.0)
    low, high = F.greatest(F.lit(0), F.floor(at(F.col("below_n") - 1)) - 1), F.least(F.lit(len(grid) - 1), F.ceil(at(F.col("below_n") + F.col("w"))) + 1)
    hit = lambda i: (F.col("below_n") <= i) & (i < F.col("below_n") + F.col("w"))
    place = lambda k: F.get(g, k) * (F.col("total_n") - 1)
    near = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    met = F.filter(near, lambda k: hit(F.floor(place(k))) | hit(F.ceil(place(k))))
    rows = rows.select("*", F.explode(met).alias("k")).withColumn("p", place(F.col("k")))
    side = F.struct("v", *[f"below_{c}" for c in names])
    rows = rows.groupBy(*by, "held", "k", *[f"total_{c}" for c in names]).agg(
        F.max(F.when(hit(F.floor("p")), side)).alias("l"), F.max(F.when(hit(F.ceil("p")), side)).alias("u"), F.max(F.col("p") - F.floor("p")).alias("f")
    )
    rows = rows.withColumn("t", F.col("l.v") + (F.col("u.v") - F.col("l.v")) * F.col("f"))
    edge = F.when(F.col("t") <= F.col("l.v"), F.col("l")).otherwise(F.col("u"))
    rows = rows.withColumn("e", edge)
    return rows.select(*by, "held", "k", "t", F.col("total_n").alias("n"), F.col("e.below_n").alias("n_below"), *[f"total_{c}" for c in sums], *[F.col(f"e.below_{c}").alias(f"below_{c}") for c in sums])


def kept_at(df: DataFrame, by: list[str], value: str, tie: str, y: str, grid: list[float], largest: bool = False) -> DataFrame:
    """(by…, g, m, pos): for each share of the grid, the m rows kept (one at least) and the positives in them.

    Rows come in the order of value and then ``tie``. Values wholly inside or outside are counted; only
    rows of a value across the edge are numbered, in pieces of the tie's range.
    """
    cells = cut(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"), F.sum(y).alias("pos")), "values")
    run = running(cells, by, value, {"below": "ties", "pos_below": "pos"}, totals={"n": "ties", "p": "pos"})
    before = F.col("n") - F.col("below") - F.col("ties") if largest else F.col("below")
    pos_before = F.col("p") - F.col("pos_below") - F.col("pos") if largest else F.col("pos_below")
    run = run.withColumn("before", before).withColumn("pos_before", pos_before)
    shares = F.array(*[F.struct(F.lit(k).alias("g"), F.lit(float(x)).alias("x")) for k, x in enumerate(grid)])
    ends = F.transform(shares, lambda s: F.struct(s["g"].alias("g"), F.greatest(F.lit(1.0), F.bround(s["x"] * F.col("n"), 0)).cast("long").alias("m")))
    ends = F.filter(ends, lambda e: (F.col("before") < e["m"]) & (e["m"] <= F.col("before") + F.col("ties")))
    at = cut(run.select(*by, value, "before", "pos_before", "ties", "pos", F.explode(ends).alias("e")).select("*", "e.*").drop("e"), "ends")  # a row per group and share
    whole = at.filter("m = before + ties").select(*by, "g", "m", (F.col("pos_before") + F.col("pos")).alias("pos"))
    across = at.filter("m < before + ties").select(*by, value, "g", "m", "before", "pos_before")
    rows = df.join(F.broadcast(across.select(*by, value).distinct()), [*by, value]).select(*by, value, tie, F.col(y).alias("y_"))
    rows = numbers(rows, [*by, value], tie, "k_").join(F.broadcast(across), [*by, value]).filter("k_ < m - before")
    part = rows.groupBy(*by, "g", "m", "pos_before").agg(F.sum("y_").alias("s")).select(*by, "g", "m", (F.col("pos_before") + F.col("s")).alias("pos"))
    return whole.unionByName(part)


def numbers(df: DataFrame, by: list[str], key: str, name: str = "k", pieces: int = 128) -> DataFrame:
    """Adds ``name``: the row's number from 0 in its group in the order of a key that is distinct in it.

    The keys' range is cut at quantiles of a bounded sample; a window runs within a group's piece and
    the pieces' counts are added as offsets, so the numbers are exact and no group passes through one task.
    """
    sample = [r[0] for r in df.select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(8 * pieces).collect()]
    sample.sort(key=lambda x: x.encode("utf-8") if isinstance(x, str) else x)
    cuts = list(dict.fromkeys(sample[8::8]))
    piece = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    df = df.withColumn("_piece", piece)
    part = df.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_c"))
    ahead = Window.partitionBy(*by or [F.lit(1)]).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row per piece
    part = part.select(*by, "_piece", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(*by, "_piece").orderBy(key))
    df = df.withColumn("_i", inside).join(part, [*by, "_piece"])
    return df.withColumn(name, F.col("_o") + F.col("_i") - 1).drop("_piece", "_i", "_o")


def auroc(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """(by…, n_pos, n_neg, auroc) by ranks with ties averaged; null where there is one class.

    A ``scope`` in ``by`` that is no column of ``df`` stands for all scopes of its data sets.
    """
    d = running(score_cells(df, by, score, y), by, "s", {"neg_below": "neg"})
    # A positive beats every negative below it and half of those it ties with.
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2.0))
    d = d.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), won.alias("won"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return d.select(*by, "n_pos", "n_neg", (F.col("won") / F.nullif(pairs, F.lit(0.0))).alias("auroc"))


def best_threshold(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """(by…, threshold, mcc): the midpoint of neighbouring scores with the highest MCC, the lowest of equals.

    With fewer than two distinct scores the threshold is 0.5 and the MCC 0. One pass over distinct
    scores with running counts, where trying each threshold would be quadratic.
    """
    d = running(score_cells(df, by, score, y), by, "s", {"fn": "pos", "tn": "neg"}, totals={"p": "pos", "n": "neg"}, previous="prev")
    d = d.withColumn("tp", F.col("p") - F.col("fn")).withColumn("fp", F.col("n") - F.col("tn"))
    d = d.select(*by, F.when(F.col("prev").isNotNull(), F.struct(mcc().alias("m"), (-(F.col("s") + F.col("prev")) / 2.0).alias("t"))).alias("b"))
    best = d.groupBy(*by).agg(F.max("b").alias("b"))
    return best.select(*by, F.coalesce(-F.col("b.t"), F.lit(0.5)).alias("threshold"), F.coalesce("b.m", F.lit(0.0)).alias("mcc"))


NO_COQA = "pooled_no_coqa"


def scoped(df: DataFrame, column: str = "dataset", pooled: str = "pooled", no_coqa: bool = True) -> DataFrame:
    """Every row in its own scope, in the pooled one, and in the pooled one without conversations.

    One expand, one aggregate for all scopes. A null data set counts in the pooled scope only.
    """
    scopes = [F.lit(pooled), F.col(column), *([F.when(F.col(column) != "coqa", NO_COQA)] if no_coqa else [])]
    return df.withColumn("scope", F.explode(F.array_compact(F.array(*scopes))))


def two_classes(y: str = "y") -> Column:
    return F.min(y) != F.max(y)
