"""Problem 1: splits that keep related records together.

1. Every group value is brought to one key; items that occur under several keys tie those keys.
2. The ties' connected components are found by star contractions.
3. Components of the same size and label profile form a bundle; only bundles reach the driver. Of very
   many kinds, the rarest are put together by size alone, so the bundles stay bounded; quotas count
   their rows as they are, only their labels are no longer told apart.
4. A minimum-cost flow spreads the bundles' rows over the splits: deviation from a split's quota costs
   most, deviation from a split's share of a label costs less.
5. The flow is rounded to whole components, large ones first, each remainder going where the gap is
   widest; single rows at the end close the gaps.
6. Components take their places in a bundle by the rank of their hash, counted in hash slots, so no
   bundle is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.llm import LLM
from tallymill.llm.flow import Network
from tallymill.llm.graphs import components
from tallymill.llm.keys import PLAIN, WIDE, folded, group_key
from tallymill.session import cut
from tallymill.sources.tables import table

KINDS = 8_000  # kinds of components (size, main label, profile) that have a bundle of their own, most frequent first
PAIRED = 1_000  # values of a component that a task pairs with all others
SLOTS, IN_SLOT = 256, 50_000  # hash slots of a bundle: at least so many, and more where a slot would hold more components


def keyed(items: DataFrame) -> DataFrame:
    """value (the group as it stands, else the item), its key, item_id and label of each row.

    A row without group_id is its item's own group; a row without both is in the group of such rows,
    whose value is null.
    """
    value = F.coalesce(F.col("group_id"), F.col("item_id"))
    return items.select(
        value.alias("value"),
        F.coalesce(group_key(value, F.coalesce(F.col("item_id"), F.lit(""))), F.lit("")).alias("key"),
        "item_id",
        F.coalesce(F.regexp_replace(F.regexp_extract(folded(F.col("item_id")), r"^([^:/|]+)", 1), "[^a-z0-9]", ""), F.lit("")).alias("label"),
    )


def tied(rows: DataFrame) -> DataFrame:
    """rows with ``part``: the hash of the least key of its component."""
    pairs = rows.filter("item_id is not null").select("item_id", "key").distinct()
    per_item = pairs.groupBy("item_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).filter("a <> z").select("item_id", "a")
    edges = pairs.join(per_item, "item_id").filter("key <> a").select("key", "a").distinct()
    roots = components(edges, "key", "a").withColumnRenamed("node", "key")
    return rows.join(roots, "key", "left").withColumn("part", F.coalesce("root", "key")).drop("root")


def quotas(total: int, plan: list[tuple[str, float]]) -> dict[str, int]:
    """Whole numbers in the plan's proportions that add up to the total (largest remainders)."""
    weight = sum(max(0.0, s or 0.0) for _, s in plan)
    if weight <= 0:
        raise ValueError("the plan's shares add up to nothing")
    exact = {k: total * max(0.0, s or 0.0) / weight for k, s in plan}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def size_class(size: Column) -> Column:
    """The size in three significant digits, rounded down: at most 900 classes to a power of ten."""
    unit = F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.floor(F.log10(size.cast("double"))) - 2))
    return (F.floor(size / unit) * unit).cast("long")


def allocate(bundles: list[tuple[float, str, int]], plan: list[tuple[str, float]]) -> list[list[int]]:
    """Components of each bundle (mean size, label, count) for each split of the plan."""
    names = [k for k, _ in plan]
    total = sum(round(s * n) for s, _, n in bundles)
    want = quotas(total, plan)
    by_label: dict[str, int] = {}
    for s, label, n in bundles:
        by_label[label] = by_label.get(label, 0) + round(s * n)
    share = {label: quotas(w, plan) for label, w in by_label.items()}
    net, arcs = Network(), {}
    for b, (s, label, n) in enumerate(bundles):
        net.arc("source", ("bundle", b), round(s * n))
        for k in names:
            arcs[b, k] = net.arc(("bundle", b), ("label", label, k), round(s * n))
    for label, own in share.items():
        for k in names:
            net.arc(("label", label, k), ("split", k), own[k])
            net.arc(("label", label, k), ("split", k), by_label[label], 1)
    for k in names:
        net.arc(("split", k), "sink", want[k])
        net.arc(("split", k), "sink", total, 10)
    if total:
        net.send("source", "sink")
    left, left_of = dict(want), {label: dict(own) for label, own in share.items()}
    out = [[0] * len(names) for _ in bundles]
    for b in sorted(range(len(bundles)), key=lambda b: (-bundles[b][0], b)):
        s, label, n = bundles[b]
        whole = {k: int(min(net.sent(arcs[b, k]) // s, max(0, left[k]) // s)) for k in names}
        rest = n - sum(whole.values())
        for k in names:
            left[k] -= s * whole[k]
            left_of[label][k] -= s * whole[k]
        while rest > 0:  # the widest gap first; as many at once as it takes for another to be wider
            k = max(names, key=lambda k: (left[k], left_of[label][k], k))
            second = max([left[x] for x in names if x != k], default=0)
            take = int(min(rest, max(1, (left[k] - second) // s)))
            whole[k] += take
            left[k] -= s * take
            left_of[label][k] -= s * take
            rest -= take
        out[b] = [whole[k] for k in names]
    return out


def assign(items: DataFrame, plan: DataFrame) -> DataFrame:
    """value, key, item_id, part, split of every row of items.

    ``plan``: split, share; it is small by its meaning (one row per split). Ties between equal hashes
    are broken by the component's name. Repeated rows count in the size of their component. An empty
    table gives an empty one; null or negative shares count as 0.
    """
    shares = [(r["split"], r["share"]) for r in plan.select("split", "share").filter("split is not null").orderBy("split").collect()]
    rows = tied(keyed(items).select("value", "key", "item_id", "label"))
    rows = cut(rows.select("value", "key", "item_id", "label", "part"), "rows")
    labels = rows.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))
    parts = labels.groupBy("part").agg(
        F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("main"), F.sum(F.hash("label", "n").cast("long")).alias("profile")
    )
    parts = cut(parts, "parts")
    bundle = ["size", "main", "profile"]
    kinds = parts.groupBy(*bundle).agg(F.count(F.lit(1)).alias("n"))
    own = kinds.orderBy(F.desc("n"), *bundle).limit(KINDS + 1).collect()
    found = [(r["size"], r["main"], r["profile"], r["n"], float(r["size"])) for r in own[:KINDS]]
    if len(own) > KINDS:  # the rest by classes of their size
        spark = items.sparkSession
        kept = spark.createDataFrame([r[:3] for r in found], "size long, main string, profile long").withColumn("kept", F.lit(True))
        parts = parts.join(F.broadcast(kept), bundle, "left").withColumn("rows", F.col("size"))  # KINDS rows
        rare = F.col("kept").isNull()
        parts = parts.select("part", "rows", F.when(rare, -size_class(F.col("size"))).otherwise(F.col("size")).alias("size"), F.when(rare, "").otherwise(F.col("main")).alias("main"), F.when(rare, 0).otherwise(F.col("profile")).alias("profile"))
        parts = cut(parts, "bundled")
        rest = parts.filter("size < 0").groupBy(*bundle).agg(F.count(F.lit(1)).alias("n"), F.avg("rows").alias("mean"))
        found += [(r["size"], r["main"], r["profile"], r["n"], r["mean"]) for r in rest.collect()]  # a row per class
    found.sort()
    slots = max([SLOTS, *(n // IN_SLOT for _, _, _, n, _ in found)])
    amounts = allocate([(int(mean) if mean == int(mean) else mean, main, n) for _, main, _, n, mean in found], shares)
    bounds = []
    for (size, main, profile, _, _), amount in zip(found, amounts, strict=True):
        at = 0
        for (name, _), n in zip(shares, amount, strict=True):
            if n:
                bounds.append((size, main, profile, at, at + n, name))
            at += n
    places = items.sparkSession.createDataFrame(bounds, "size long, main string, profile long, low long, high long, split string")
    ranked = parts.withColumn("h", F.xxhash64("part", F.lit("place"))).withColumn("slot", F.pmod("h", F.lit(slots)))
    counted = ranked.groupBy(*bundle, "slot").agg(F.count(F.lit(1)).alias("in_slot"))
    before = counted.withColumn(
        "before", F.coalesce(F.sum("in_slot").over(Window.partitionBy(*bundle).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("in_slot")
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*bundle, "slot").orderBy("h", "part")))
    ranked = ranked.join(before, [*bundle, "slot"]).withColumn("rank", F.col("r") + F.col("before") - 1)
    placed = (
        ranked.join(F.broadcast(places), bundle)  # KINDS and the classes of size, times the number of splits
        .filter("rank >= low and rank < high")
        .select("part", "split")
    )
    return rows.join(placed, "part").select("value", "key", "item_id", "part", "split")


@LLM.query("p1_splits")
def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every row: item_id, group value, split, component."""
    out = assign(table(spark, sf_dir, "items", "item_id", "group_id"), table(spark, sf_dir, "split_plan"))
    return out.select("item_id", F.col("value").alias("group_value"), "split", F.sha2("part", 256).alias("component"))


_REPORT = """
with p as (select split, greatest(coalesce(share, 0), 0) / (select sum(greatest(coalesce(share, 0), 0)) from split_plan where split is not null) as share from split_plan where split is not null),
     t as (select count(*) as n from items), e as (select split, n * share as exact, floor(n * share) as low, n from p, t),
     r as (select *, row_number() over (order by low - exact, split) as r, n - sum(low) over () as spare from e)
select split, cast(low + case when r <= spare then 1 else 0 end as bigint) as n_rows, cast(low + case when r <= spare then 1 else 0 end as bigint) as wanted,
       round((low + case when r <= spare then 1 else 0 end) / n, 9) as share from r"""


@LLM.query("p1_report", sql=_REPORT)
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split beside the rows its quota wants, and the share reached."""
    plan = table(spark, sf_dir, "split_plan")
    out = assign(table(spark, sf_dir, "items", "item_id", "group_id"), plan).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = {r["split"]: r["n_rows"] for r in out.collect()}  # a row per split
    want = quotas(sum(rows.values()), [(r["split"], r["share"]) for r in plan.filter("split is not null").orderBy("split").collect()])
    total = max(1, sum(rows.values()))
    return spark.createDataFrame([(k, rows.get(k, 0), n, round(rows.get(k, 0) / total, 9)) for k, n in want.items()], "split string, n_rows long, wanted long, share double")


def _sql_key() -> str:
    """The key of a value v of an item i, in SQL."""
    unseen = r"[\p{Z}\p{C}\s\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]"
    plain = PLAIN.replace("'", "''")
    fold = lambda c: f"regexp_replace(lower(upper(translate({c}, '{WIDE}', '{plain}'))), '{unseen}', '', 'g')"
    strong = r"^([\p{L}\p{N}][\p{L}\p{N}_\-]*?)[_\-]*[^\p{L}\p{N}_\-][^\p{L}\p{N}]*(.*)$"
    weak = r"^([\p{L}\p{N}]+)[_\-]+(.*)$"
    bare = lambda c: f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    return f"""
f as (select distinct item_id, coalesce(group_id, item_id) as value, {fold('coalesce(group_id, item_id)')} as v,
        {bare("regexp_extract(" + fold('item_id') + ", '^([^:/|]+)', 1)")} as own from items where coalesce(group_id, item_id) is not null),
k as (select item_id, value, case
        when regexp_matches(v, '{strong}') then {bare(f"regexp_extract(v, '{strong}', 1)")} || ':' || regexp_extract(v, '{strong}', 2)
        when own <> '' and starts_with({bare('v')}, own) and length({bare('v')}) > length(own)
          then own || ':' || regexp_extract(v, '^' || regexp_replace(own, '(.)', '\\1[_\\-]*', 'g') || '(.*)$', 1)
        when regexp_matches(v, '{weak}') then regexp_extract(v, '{weak}', 1) || ':' || regexp_extract(v, '{weak}', 2)
        else v end as key from f)"""


_FOUND = "with recursive " + _sql_key().strip() + """,
e as (select distinct a.key as a, b.key as b from k a join k b on a.item_id = b.item_id and a.key <> b.key),
r(key, root) as (select key, key from k union select e.b, r.root from r join e on e.a = r.key),
c as (select key, min(root) as part from r group by key),
g as (select distinct value, part from k join c using (key))
select a.value as group_a, b.value as group_b from g a join g b on a.part = b.part and a.value < b.value"""


@LLM.query("p1_found", sql=_FOUND)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different group values that must be in one split, from the assigned rows."""
    out = assign(table(spark, sf_dir, "items", "item_id", "group_id"), table(spark, sf_dir, "split_plan"))
    values = cut(out.filter("value is not null").select("value", "part", "split").distinct(), "values")
    # A component's pairs are dealt over tasks: one side by a hash, the other once for each.
    many = values.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("part", F.ceil(F.col("n") / PAIRED).cast("int").alias("tasks"))
    values = values.join(many, "part")
    a = values.select("part", "split", F.pmod(F.xxhash64("value"), F.col("tasks")).cast("int").alias("task"), F.col("value").alias("group_a"))
    b = values.select("part", "split", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.col("value").alias("group_b"))
    return a.join(b, ["part", "split", "task"]).filter("group_a < group_b").select("group_a", "group_b")
