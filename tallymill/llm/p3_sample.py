"""Problem 3: a sample that matches target category proportions.

One pass brings the rows to distinct scored items of each category, each with a priority hashed from
the item. A category's reservoir is its items of least priority, up to a capacity; partial reservoirs
merge by adding their histograms over priority slots, so no category is ever held by one task. After
the final counts a reservoir ends at a slot: a row per category goes to every task, slots before it
are in, and only the slot across the end is ranked. Reservoirs that are not full name the exhausted
categories; the sample trims each reservoir to its feasible quota in the same way.

Quotas: where a category is exhausted or lifted by its minimum, the others share what is left of the
sample's size in proportion to their targets. All quotas are one multiple of the targets, cut to what
there is and lifted to the minimum, with the multiple for which they add up to the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.llm import LLM
from tallymill.session import cut
from tallymill.sources.tables import table

DIGITS = 4  # hexadecimal digits of a priority that make a slot: 65,536 slots in a category
TENTH = 10


def plain(c):  # noqa: ANN001, ANN201
    """Spelling of a data set without case, white space, hyphens and underscores."""
    return F.regexp_replace(F.lower(c), r"[\s\p{Z}\p{Pd}_]", "")


def scored(predictions: DataFrame) -> DataFrame:
    """Distinct (name, y, item_id) with y 0 or 1; rows without item_id or data set are left out.

    Whether score or pred is null plays no part. An item with both labels counts for both.
    """
    rows = predictions.filter(F.col("y").isin(0, 1) & F.col("item_id").isNotNull() & F.col("dataset").isNotNull())
    return rows.select(plain(F.col("dataset")).alias("name"), F.col("y").cast("int").alias("y"), "item_id").distinct()


def categories(targets: DataFrame) -> DataFrame:
    """The targets with the plain name; null shares and minima count as 0."""
    return targets.filter("dataset is not null and y is not null").select(
        "dataset",
        F.col("y").cast("int").alias("y"),
        plain(F.col("dataset")).alias("name"),
        F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("min_rows"), F.lit(0)).cast("long").alias("min_rows"),
    )


def feasible(rows: list[tuple[int, int, float]], size: int) -> list[int]:
    """Quotas of (available, minimum, share) that add up to the size, or as near to it as there are rows.

    The multiple of the shares is found between the points where a category leaves its minimum or is
    exhausted. Whole numbers go by the largest remainders, earlier rows first.
    """
    low = [min(a, m) for a, m, _ in rows]
    at = lambda x: [min(a, max(b, x * s)) for (a, _, s), b in zip(rows, low, strict=True)]
    points = sorted({0.0, *[v / s for (a, _, s), b in zip(rows, low, strict=True) if s > 0 for v in (b, a)]})
    below = [x for x in points if round(sum(at(x)), 6) <= size]
    above = [x for x in points if round(sum(at(x)), 6) > size]
    scale = below[-1] if below else 0.0
    if below and above:
        a, b = sum(at(below[-1])), sum(at(above[0]))
        scale += (size - a) * (above[0] - below[-1]) / (b - a)
    exact = [round(x, 6) for x in at(scale)]
    out = [int(x) for x in exact]
    spare = int(round(sum(exact))) - sum(out)
    for k in sorted(range(len(out)), key=lambda k: (out[k] - exact[k], k))[: max(0, spare)]:
        out[k] += 1 if out[k] < rows[k][0] else 0
    return out


def needs(items: DataFrame, targets: DataFrame, size: int | None = None) -> DataFrame:
    """Per category: wanted (share times the sample's size, or the minimum), available, capacity, quota, short.

    The size is a tenth of all distinct scored items, rounded down, unless given. Shares are taken as
    decimals of nine places, so that 0.07 of 100 is 7. The capacity is what the category wants, the
    quota what the sample can give it. The targets are a small table: a row per category.
    """
    n = items.select("item_id").distinct().count() // TENTH if size is None else size
    counts = items.groupBy("name", "y").agg(F.count(F.lit(1)).alias("available"))
    out = categories(targets).join(counts, ["name", "y"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    wanted = F.greatest(F.col("min_rows").cast("decimal(30,9)"), F.col("target_share").cast("decimal(12,9)") * F.lit(n).cast("decimal(18,0)"))
    out = out.withColumn("wanted", wanted.cast("decimal(30,9)")).select(
        "dataset", "y", "name", F.col("wanted").cast("double").alias("wanted"), "available",
        F.ceil("wanted").cast("long").alias("capacity"), (F.col("available") < F.col("wanted")).alias("short"), "min_rows", "target_share",
    )
    rows = sorted(out.collect(), key=lambda r: (r["dataset"], r["y"]))
    quotas = feasible([(r["available"], r["min_rows"], r["target_share"]) for r in rows], n)
    data = [(r["dataset"], r["y"], r["name"], r["wanted"], r["available"], r["capacity"], q, r["short"]) for r, q in zip(rows, quotas, strict=True)]
    return items.sparkSession.createDataFrame(data, "dataset string, y int, name string, wanted double, available long, capacity long, quota long, short boolean")


def reservoirs(items: DataFrame, need: DataFrame, limit: str = "capacity") -> DataFrame:
    """dataset, y, item_id: each category's items of least priority, up to its limit.

    Equal priorities are told apart by item_id. A reservoir is not full only where all items are in it.
    """
    ranked = items.withColumn("p", F.md5(F.concat_ws(":", F.lit("sample"), "item_id"))).withColumn("slot", F.substring("p", 1, DIGITS))
    held = ranked.groupBy("name", "y", "slot").agg(F.count(F.lit(1)).alias("k"))  # histograms of partial reservoirs, added up
    run = Window.partitionBy("name", "y").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("k").over(run), F.lit(0))).join(F.broadcast(need.select("dataset", "name", "y", F.col(limit).alias("limit"))), ["name", "y"])
    ends = held.filter("before < limit").groupBy("dataset", "name", "y", "limit").agg(F.max(F.struct("slot", "before", "k")).alias("e"))
    ends = ends.select("dataset", "name", "y", "limit", F.col("e.slot").alias("end"), F.col("e.before").alias("before"), (F.col("e.before") + F.col("e.k") > F.col("limit")).alias("part"))
    kept = ranked.join(F.broadcast(ends), ["name", "y"]).filter("slot <= end")  # a row per category
    at = Window.partitionBy("name", "y").orderBy("p", "item_id")
    across = kept.filter("part and slot = end").withColumn("r", F.row_number().over(at)).filter("r + before <= limit")
    return kept.filter("not part or slot < end").select("dataset", "y", "item_id").unionByName(across.select("dataset", "y", "item_id"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = cut(scored(table(spark, sf_dir, "predictions", "item_id", "dataset", "y")), "scored")
    return items, needs(items, table(spark, sf_dir, "sample_targets"))


_NAME = "regexp_replace(lower({}), '[\\s\\p{{Z}}\\p{{Pd}}_]', '', 'g')"
_NEEDS = f"""
with s as (select distinct {_NAME.format('dataset')} as name, y, item_id from predictions
           where y in (0, 1) and item_id is not null and dataset is not null),
     n as (select count(distinct item_id) // 10 as n from s),
     c as (select name, y, count(*) as available from s group by all),
     need as (select t.dataset, t.y, {_NAME.format('t.dataset')} as name, coalesce(c.available, 0) as available, n.n as size,
                coalesce(t.target_share, 0) as share, least(coalesce(c.available, 0), coalesce(t.min_rows, 0)) as low,
                greatest(cast(t.min_rows as decimal(28, 9)), cast(cast(t.target_share as decimal(12, 9)) * n.n as decimal(28, 9))) as wanted
              from sample_targets t cross join n left join c on c.name = {_NAME.format('t.dataset')} and c.y = t.y)
"""
_QUOTAS = _NEEDS + """,
     pt as (select distinct x from (select 0e0 as x union all select low / share from need where share > 0 union all select available / share from need where share > 0)),
     tt as (select x, sum(least(available, greatest(low, x * share))) as t from pt, need group by x),
     lo as (select max(x) as x, arg_max(t, x) as t from tt where round(t, 6) <= (select n from n)),
     hi as (select min(x) as x, arg_min(t, x) as t from tt where round(t, 6) > (select n from n)),
     sc as (select case when lo.x is null then 0e0 when hi.x is null then lo.x else lo.x + (n.n - lo.t) * (hi.x - lo.x) / (hi.t - lo.t) end as x from lo, hi, n),
     ex as (select need.*, round(least(available, greatest(low, sc.x * share)), 6) as e from need, sc),
     rn as (select *, row_number() over (order by floor(e) - e, dataset, y) as r, round(sum(e) over ()) - sum(floor(e)) over () as spare from ex),
     qu as (select *, cast(least(available, floor(e) + case when r <= spare then 1 else 0 end) as bigint) as quota from rn)
"""


@LLM.query("p3_sample", sql=_QUOTAS + """,
     pr as (select s.name, s.y, s.item_id, row_number() over (partition by s.name, s.y order by md5('sample:' || s.item_id), s.item_id) as r from s)
select qu.dataset, qu.y, pr.item_id from pr join qu on qu.name = pr.name and qu.y = pr.y where pr.r <= qu.quota""")
def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample's items by category: the reservoirs, trimmed to the feasible quotas."""
    items, need = _tables(spark, sf_dir)
    return reservoirs(items, need, "quota")


@LLM.query("p3_report", sql=_QUOTAS + """
select dataset, y, cast(wanted as double) as wanted, available, cast(ceil(wanted) as bigint) as capacity, quota, available < wanted as short from qu""")
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted, available and quota of each category, and whether it falls short."""
    items, need = _tables(spark, sf_dir)
    return need.drop("name")


@LLM.query("p3_found", sql=_NEEDS + "select dataset, y from need where available < wanted")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that fall short: those whose reservoir, of the capacity they want, is not full."""
    items, need = _tables(spark, sf_dir)
    held = reservoirs(items, need).groupBy("dataset", "y").agg(F.count(F.lit(1)).alias("held"))
    return need.join(held, ["dataset", "y"], "left").filter(F.coalesce("held", F.lit(0)) < F.col("wanted") - 1e-9).select("dataset", "y")
