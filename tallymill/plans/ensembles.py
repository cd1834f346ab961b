"""Draws, folds, bootstrap; votes, routing and transfer over stored scores."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.functions import expressions as X
from tallymill.functions import sqltext as S
from tallymill.functions.expressions import order_hash, out
from tallymill.operators import ranked as R
from tallymill.operators import sampling as G
from tallymill.operators.paired import method_pairs
from tallymill.plans.metrics import held_out_threshold, sql_held_out
from tallymill.registry import CORE
from tallymill.session import cores_of, cut
from tallymill.sources import views as V

q = CORE.query
FOLDS, SEED = 5, "fold"

# Items of the wide view with folds, and their scores and decisions in long form.
SQL_FOLDED = V.SQL_WIDE + ",\n" + G.SQL_FOLDS.format(source="wide", seed=SEED, n=FOLDS) + """,
wf as (select wide.*, fold from wide join folds using (group_id)),
emb as (select item_id, dataset, group_id, y, label, fold, method, score, cast(score >= 0 as int) as pred from wf unpivot (score for method in (%s)))""" % ", ".join(V.METHODS)


def folded(spark: SparkSession, d: str) -> DataFrame:
    w = V.wide(spark, d)
    return w.join(G.group_folds(w, FOLDS, SEED), "group_id")


def long_folded(spark: SparkSession, d: str) -> DataFrame:
    return V.long(folded(spark, d))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """One row per scored item of the predictions, with its group (else itself) and label."""
    p = V.predictions(spark, d)
    return p.groupBy("item_id").agg(F.max("dataset").alias("dataset"), F.coalesce(F.max("group_id"), F.col("item_id")).alias("group_id"), F.max("y").alias("y"))


SQL_ITEMS = V.SQL_PREDICTIONS + """,
its as (select item_id, max(dataset) as dataset, coalesce(max(group_id), item_id) as group_id, max(y) as y from pred group by item_id)"""


@q("sample_pool", sql=S.with_(SQL_ITEMS, "r as (select item_id, row_number() over (order by md5('pool:' || item_id), item_id) as r from its)") + "select item_id from r where r <= 500")
def sample_pool(spark: SparkSession, d: str) -> DataFrame:
    """A pool of 500 items by hash order; all items if there are fewer (a top-k, so no full sort)."""
    return _items(spark, d).orderBy(order_hash(F.lit("pool"), "item_id"), "item_id").limit(500).select("item_id")


@q("draw_combine", sql=S.with_(SQL_ITEMS, "r as (select *, row_number() over (partition by dataset order by md5('draw:' || item_id), item_id) as r from its)") + "select dataset, item_id, y from r where r <= 100")
def draw_combine(spark: SparkSession, d: str) -> DataFrame:
    """A hundred items of each data set, put together."""
    return G.draw(_items(spark, d), ["dataset"], 100, "draw").select("dataset", "item_id", "y")


@q("fold_assign", sql=S.with_(SQL_ITEMS, G.SQL_FOLDS.format(source="its", seed="outer", n=5)) + "select item_id, fold from its join folds using (group_id)")
def fold_assign(spark: SparkSession, d: str) -> DataFrame:
    """Five folds over groups, stratified by data set and label."""
    i = _items(spark, d)
    return i.join(G.group_folds(i, 5, "outer"), "group_id").select("item_id", "fold")


@q("fold_leakage", sql=S.with_(SQL_ITEMS, G.SQL_FOLDS.format(source="its", seed="outer", n=5), "l as (select group_id, count(distinct fold) as k from its join folds using (group_id) group by all)") + "select count(*) as n_groups, count(*) filter (where k > 1) as n_leaking from l")
def fold_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Groups in more than one fold; there are none."""
    i = _items(spark, d)
    k = i.join(G.group_folds(i, 5, "outer"), "group_id").groupBy("group_id").agg(F.min("fold").alias("a"), F.max("fold").alias("z"))
    return k.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(X.count_if(F.col("a") != F.col("z")), F.lit(0)).alias("n_leaking"))


@q("folds_then_filter", sql=S.with_(SQL_ITEMS, G.SQL_FOLDS.format(source="its", seed="outer", n=5)) + "select fold, count(*) as n, cast(sum(y) as bigint) as n_pos from its join folds using (group_id) where dataset <> 'coqa' group by all")
def folds_then_filter(spark: SparkSession, d: str) -> DataFrame:
    """Folds of all items, a data set left out afterwards, so that the partition stays the same."""
    i = _items(spark, d)
    f = i.join(G.group_folds(i, 5, "outer"), "group_id").filter("dataset <> 'coqa'")
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_pos"))


@q(
    "group_subsample",
    sql=S.with_(SQL_ITEMS, "g as (select group_id, count(*) as k, md5('sub:' || group_id) as h from its group by all)", "c as (select group_id, coalesce(sum(k) over (order by h, group_id rows between unbounded preceding and 1 preceding), 0) as before from g)", "r as (select item_id, before + row_number() over (partition by group_id order by md5('sub:' || item_id), item_id) as r from its join c using (group_id))") + "select item_id from r where r <= 400",
)
def group_subsample(spark: SparkSession, d: str) -> DataFrame:
    """Whole groups in hash order until 400 items; the last group is cut."""
    i = _items(spark, d)
    g = i.groupBy("group_id").agg(F.count(F.lit(1)).alias("k")).withColumn("h", order_hash(F.lit("sub"), "group_id"))
    # Only the first groups matter: 400 of them hold at least 400 items.
    first = g.orderBy("h", "group_id").limit(400)
    before = F.coalesce(F.sum("k").over(Window.partitionBy(F.lit(1)).orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("before", before).filter("before < 400").select("group_id", "before")
    w = Window.partitionBy("group_id").orderBy(order_hash(F.lit("sub"), "item_id"), "item_id")
    return i.join(F.broadcast(first), "group_id").withColumn("r", F.col("before") + F.row_number().over(w)).filter("r <= 400").select("item_id")


@q("balanced_subsample", sql=S.with_(SQL_ITEMS, "k as (select 300 // count(distinct dataset) as quota from its)", "r as (select *, row_number() over (partition by dataset order by md5('bal:' || item_id), item_id) as r from its)") + "select dataset, item_id from r, k where r <= quota")
def balanced_subsample(spark: SparkSession, d: str) -> DataFrame:
    """Three hundred items, an equal quota of each data set."""
    i = _items(spark, d)
    k = i.agg(F.count_distinct("dataset")).first()[0]
    return G.draw(i, ["dataset"], 300 // max(1, k), "bal").select("dataset", "item_id")


@q(
    "audit_sample",
    sql=S.with_(
        V.SQL_PREDICTIONS, "e as (select item_id, dataset, case when pred = 1 then 'fp' else 'fn' end as kind from pred where method = 'saplma' and pred <> y)",
        "d as (select dataset, count(*) as n, count(*) filter (where kind = 'fp') as n_fp from e group by all)",
        "t as (select dataset, least(n, 20) as take, cast(round_even(least(n, 20) * n_fp / cast(n as double), 0) as bigint) as take_fp from d)",
        "r as (select e.*, row_number() over (partition by dataset, kind order by md5('audit:' || item_id), item_id) as r from e)",
    )
    + "select r.dataset, item_id, kind from r join t using (dataset) where r <= case when kind = 'fp' then take_fp else take - take_fp end",
)
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty errors of each data set, false positives and negatives in their proportion."""
    e = V.predictions(spark, d).filter("method = 'saplma' and pred <> y").select("item_id", "dataset", F.when(F.col("pred") == 1, "fp").otherwise("fn").alias("kind"))
    t = e.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), X.count_if(F.col("kind") == "fp").alias("n_fp"))
    take = F.least(F.col("n"), F.lit(20))
    t = t.select("dataset", take.alias("take"), F.bround(take * F.col("n_fp") / F.col("n").cast("double"), 0).cast("long").alias("take_fp"))
    w = Window.partitionBy("dataset", "kind").orderBy(order_hash(F.lit("audit"), "item_id"), "item_id")
    r = e.withColumn("r", F.row_number().over(w)).join(t, "dataset")
    return r.filter(F.col("r") <= F.when(F.col("kind") == "fp", F.col("take_fp")).otherwise(F.col("take") - F.col("take_fp"))).select("dataset", "item_id", "kind")


@q(
    "transfer_arms",
    sql=S.with_(SQL_ITEMS, "n as (select dataset, count(*) as n from its group by all)", "a as (select unnest(['single', 'lodo', 'lodo_matched', 'pooled']) as arm)", "t as (select a.arm, x.dataset as target, s.dataset as source, s.n, x.n as own, (select count(*) from n) - 1 as others from a, n x, n s where case arm when 'single' then true when 'pooled' then true else s.dataset <> x.dataset end)")
    + "select arm, target, source, cast(case arm when 'lodo_matched' then least(n, own // others) else n end as bigint) as n_train from t",
)
def transfer_arms(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each source that each transfer arm trains on, for each target data set."""
    n = _items(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    one = n.agg(F.collect_list(F.struct("dataset", "n")).alias("all"))  # one row per data set
    t = one.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("s"), (F.size("all") - 1).alias("others"))
    t = t.select(F.explode(F.array(*[F.lit(a) for a in ("single", "lodo", "lodo_matched", "pooled")])).alias("arm"), F.col("x.dataset").alias("target"), F.col("s.dataset").alias("source"), F.col("s.n").alias("n"), F.col("x.n").alias("own"), "others")
    t = t.filter(F.col("arm").isin("single", "pooled") | (F.col("source") != F.col("target")))
    return t.select("arm", "target", "source", F.when(F.col("arm") == "lodo_matched", F.least(F.col("n"), F.floor(F.col("own") / F.col("others")))).otherwise(F.col("n")).cast("long").alias("n_train"))


_ARMS = ("single", "lodo", "lodo_matched", "pooled")


@q(
    "transfer_rows",
    sql=S.with_(SQL_ITEMS, "n as (select dataset, count(*) as n from its group by all)", "o as (select *, row_number() over (partition by dataset order by md5('transfer:' || item_id), item_id) as r from its)",
        "t as (select x.dataset as target, x.n as own, (select count(*) from n) - 1 as others, unnest(['single', 'lodo', 'lodo_matched', 'pooled']) as arm from n x)")
    + "select arm, target, o.dataset as source, item_id, y from t join o on case arm when 'single' then true when 'pooled' then true else o.dataset <> t.target end where arm <> 'lodo_matched' or r <= own // others",
)
def transfer_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows that each transfer arm trains on, for each target data set; a matched arm takes its quota in hash order."""
    i = _items(spark, d)
    n = i.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("dataset", "n")).alias("all"))  # one row, an entry per data set
    r = G.hash_numbers(i.withColumn("h", order_hash(F.lit("transfer"), "item_id")), ["dataset"], "h", "item_id", "r").join(F.broadcast(n))
    r = r.select(F.col("dataset").alias("source"), "item_id", "y", "r", (F.size("all") - 1).alias("others"), F.explode("all").alias("x")).select("*", F.explode(F.array(*[F.lit(a) for a in _ARMS])).alias("arm"))
    take = F.col("arm").isin("single", "pooled") | (F.col("source") != F.col("x.dataset"))
    matched = (F.col("arm") != "lodo_matched") | (F.col("r") < F.floor(F.col("x.n") / F.col("others")))
    return r.filter(take & matched).select("arm", F.col("x.dataset").alias("target"), "source", "item_id", "y")


@q(
    "nested_folds",
    sql=S.with_(SQL_ITEMS, G.SQL_FOLDS.format(source="its", seed="outer", n=5),
        "h as (select held, m.group_id, m.stratum, fold from fold_m m join folds using (group_id), (select unnest(range(5)) as held))",
        "i as (select held, group_id, fold, (row_number() over (partition by held, fold = held, stratum order by md5('inner:' || held || ':' || cast(group_id as varchar)), group_id) - 1) % 4 as inner_fold from h)")
    + "select cast(held as int) as held, item_id, case when fold = held then 'test' when inner_fold = 0 then 'validation' else 'train' end as role from its join i using (group_id)",
)
def nested_folds(spark: SparkSession, d: str) -> DataFrame:
    """For each held fold, every item's role: test, or train and validation by the first of four inner folds over whole groups."""
    i = _items(spark, d)
    return i.join(G.nested_groups(i, 5, 4, "outer", "inner"), "group_id").select("held", "item_id", "role")


_REPS = 1000
_CELL = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
_BOOT_COUNTS = [f"{m}_{c}" for m in ("a", "b") for c in _CELL]
_PAIR_KEYS = "run, seed, method_a, method_b"


@q(
    "bootstrap_ci",
    sql=S.with_(
        V.SQL_PREDICTIONS,
        "ok as (select * from pred where pred is not null)",
        "ab as (select a.run, a.seed, coalesce(greatest(a.group_id, b.group_id), a.item_id) as grp, a.method as method_a, b.method as method_b, greatest(a.y, b.y) as y, a.pred as pa, b.pred as pb from ok a join ok b on a.run = b.run and a.seed = b.seed and a.fold = b.fold and a.dataset = b.dataset and a.item_id = b.item_id and a.method < b.method)",
        "c as (select %s, grp, %s from ab group by all)" % (_PAIR_KEYS, ", ".join(f"count(*) filter (where y = {y} and p{m} = {p}) as {m}_{k}" for m in "ab" for k, (y, p) in _CELL.items())),
        "g as (select *, cast(('0x' || substr(md5('boot:' || run || ':' || seed || ':' || grp), 1, 7)) as bigint) as g from c)",
        f"s as (select *, {G.sql_bootstrap_weight('g', 'r')} as times from g, (select unnest(range({_REPS})) as r))",
        f"b as (select {_PAIR_KEYS}, r, {', '.join(f'sum(times * {x}) as {x}' for x in _BOOT_COUNTS)} from s group by all)",
        f"v as (select {_PAIR_KEYS}, {S.mcc('a_tp', 'a_fp', 'a_fn', 'a_tn')} - {S.mcc('b_tp', 'b_fp', 'b_fn', 'b_tn')} as diff from b)",
        f"h as (select {_PAIR_KEYS}, avg(diff) as mean, quantile_cont(diff, 0.025e0) as lo, quantile_cont(diff, 0.975e0) as hi from v group by all)",
    )
    + "select run, method_a, method_b, count(*) as n_seeds, round(avg(mean), 6) as difference, round(avg(lo), 6) as low, round(avg(hi), 6) as high, bool_and(lo > 0 or hi < 0) as excludes_zero_all_seeds from h group by all",
)
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Group bootstrap of the MCC difference of every pair of methods: a thousand replicates in each run and seed, averaged over seeds.

    A pair counts on the items that have both decisions, and all pairs of a seed share its draws. Rows
    are counted by group first; a replicate is a sum over these counts, combined before any shuffle.
    """
    ab = method_pairs(V.predictions(spark, d).filter("pred is not null"), ["run", "seed", "fold", "dataset", "item_id"], ["group_id", "y", "pred"])
    group = F.coalesce(F.greatest("a.group_id", "b.group_id"), "item_id").alias("grp")
    ab = ab.select("run", "seed", group, F.col("a.method").alias("method_a"), F.col("b.method").alias("method_b"), F.greatest("a.y", "b.y").alias("y"), F.col("a.pred").alias("pa"), F.col("b.pred").alias("pb"))
    keys = ["run", "seed", "method_a", "method_b"]
    c = ab.groupBy(*keys, "grp").agg(*[X.count_if((F.col("y") == t) & (F.col(f"p{m}") == s)).alias(f"{m}_{k}") for m in "ab" for k, (t, s) in _CELL.items()])
    c = cut(c, "counts")
    names = c.select(*keys).distinct().withColumn("pair", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*keys)))  # over a row per run, seed and pair
    names = cut(names, "pairs")
    c = c.join(F.broadcast(names), keys).select("pair", G.group_number(F.lit("boot"), "run", F.col("seed").cast("string"), "grp").alias("g"), *_BOOT_COUNTS)
    c = c.repartition(4 * cores_of(spark), "pair", "g")  # groups are few beside their replicates: spread them first
    c = c.select("pair", "g", *_BOOT_COUNTS, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_REPS - 1).cast("long"))).alias("r")).withColumn("times", G.bootstrap_weight(F.col("g"), F.col("r"))).filter("times > 0")
    b = c.groupBy("pair", "r").agg(*[F.sum(F.col("times") * F.col(x)).alias(x) for x in _BOOT_COUNTS])
    every = names.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_REPS - 1).cast("long"))))
    b = every.join(b, ["pair", "r"], "left").na.fill(0, _BOOT_COUNTS)  # a replicate that draws no group of the pair differs by 0
    diff = X.mcc("a_tp", "a_fp", "a_fn", "a_tn") - X.mcc("b_tp", "b_fp", "b_fn", "b_tn")
    at = F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975)))  # of a thousand numbers
    h = b.select(*keys, diff.alias("diff")).groupBy(*keys).agg(F.avg("diff").alias("mean"), at.alias("p")).withColumn("lo", F.col("p")[0]).withColumn("hi", F.col("p")[1])
    return h.groupBy("run", "method_a", "method_b").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("mean"), 6).alias("difference"), F.round(F.avg("lo"), 6).alias("low"), F.round(F.avg("hi"), 6).alias("high"),
        F.bool_and((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero_all_seeds"),
    )


LEAST_IN_CLUSTER, PERMUTATIONS = 20, 500


def _cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per cluster (the label): rows, rows where the anchor errs, and how many of these the others rescue."""
    w = V.wide(spark, d)
    right = {m: ((F.col(m) >= 0).cast("int") == F.col("y")).cast("int") for m in V.METHODS}
    others = X.total([right[m] for m in V.METHODS if m != "saplma"])
    wrong = right["saplma"] == 0
    return w.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n_total"), X.count_if(wrong).alias("n"), X.count_if(wrong & (others >= 3)).alias("m"))


_CLUSTERS = "cl as (select label as cluster, count(*) as n_total, count(*) filter (where cast(saplma >= 0 as int) <> y) as n, count(*) filter (where cast(saplma >= 0 as int) <> y and (%s) >= 3) as m from wide group by all), ba as (select cast(sum(n) as bigint) as nn, cast(sum(m) as bigint) as mm, sum(m) / cast(sum(n) as double) as base from cl)" % " + ".join(f"cast(cast({m} >= 0 as int) = y as int)" for m in V.METHODS if m != "saplma")
_STATISTIC = f"sum(n * abs({{m}} / cast(n as double) - base)) filter (where n >= {LEAST_IN_CLUSTER}) / max(nn)"


@q(
    "enrichment",
    sql=S.with_(V.SQL_WIDE, _CLUSTERS, f"st as (select {_STATISTIC.format(m='m')} as statistic from cl, ba)")
    + f"select cluster, n as n_eligible, n_total, round(m / cast(n as double), 9) as rate, round(m / cast(n as double) / nullif(base, 0), 9) as lift, round(statistic, 9) as statistic from cl, ba, st where n >= {LEAST_IN_CLUSTER}",
)
def enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Rescue rate and lift by cluster of twenty eligible rows or more, and their weighted deviation from the base rate over all eligible rows."""
    one = Window.partitionBy(F.lit(1))  # over one row per cluster
    e = _cluster_counts(spark, d).withColumn("nn", F.sum("n").over(one)).withColumn("base", F.sum("m").over(one) / F.sum("n").over(one).cast("double"))
    e = e.filter(F.col("n") >= LEAST_IN_CLUSTER).withColumn("rate", F.col("m") / F.col("n").cast("double"))
    stat = F.sum(F.col("n") * F.abs(F.col("rate") - F.col("base"))).over(one) / F.col("nn")
    return e.select("cluster", F.col("n").alias("n_eligible"), "n_total", out("rate").alias("rate"), out(X.ratio(F.col("rate"), F.col("base"))).alias("lift"), out(stat).alias("statistic"))


_DEAL = f"""
cn as (select *, row_number() over (order by cluster) as idx from cl),
w(r, idx, cluster, n, m, nl, ml) as (
  select r, cast(0 as bigint), null::int, cast(0 as bigint), cast(0 as bigint), nn, mm from (select unnest(range({PERMUTATIONS})) as r), ba
  union all
  select r, idx, cluster, n, x, nl - n, ml - x from (
    select w.r, cn.idx, cn.cluster, cn.n, w.nl, w.ml,
      cast(len(list_filter(range(0, cn.n + 1), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: case when j <= w.ml and cn.n - j <= w.nl - w.ml
        then exp(lgamma(w.ml + 1e0) - lgamma(j + 1e0) - lgamma(w.ml - j + 1e0) + lgamma(w.nl - w.ml + 1e0) - lgamma(cn.n - j + 1e0) - lgamma(w.nl - w.ml - cn.n + j + 1e0)
               - lgamma(w.nl + 1e0) + lgamma(cn.n + 1e0) + lgamma(w.nl - cn.n + 1e0)) else 0e0 end))
        < cast(('0x' || substr(md5('perm:' || w.r || ':' || cn.cluster), 1, 12)) as bigint) / 281474976710656e0)) as bigint) as x
    from w join cn on cn.idx = w.idx + 1) z)"""


@q(
    "permutation_null",
    sql="with recursive " + ",\n".join(x.strip() for x in (V.SQL_WIDE, _CLUSTERS, _DEAL, f"st as (select {_STATISTIC.format(m='m')} as statistic from cl, ba)", f"ps as (select r, {_STATISTIC.format(m='m')} as v from w, ba where idx > 0 group by r)"))
    + "\nselect round(max(statistic), 9) as statistic, round(avg(v), 9) as null_mean, round(avg(cast(v >= statistic - 1e-12 as int)), 9) as p from ps, st",
)
def permutation_null(spark: SparkSession, d: str) -> DataFrame:
    """Chance of the enrichment when the marks are dealt anew over the eligible rows: five hundred permutations.

    A permutation deals each cluster a hypergeometric number of the marks left, so it costs one number
    per cluster and never touches rows. Only the counts by cluster reach the driver.
    """
    c = sorted((r["cluster"], r["n"], r["m"]) for r in _cluster_counts(spark, d).collect())
    total, marked = sum(n for _, n, _ in c), sum(m for _, _, m in c)

    def statistic(ms: list[int]) -> float:
        return sum(n * abs(m / n - marked / total) for (_, n, _), m in zip(c, ms, strict=True) if n >= LEAST_IN_CLUSTER) / total

    if not total:
        return spark.createDataFrame([(None, None, None)], "statistic double, null_mean double, p double")
    own, null = statistic([m for _, _, m in c]), []
    for r in range(PERMUTATIONS):
        left, marks, ms = total, marked, []
        for cluster, n, _ in c:
            u = int(hashlib.md5(f"perm:{r}:{cluster}".encode()).hexdigest()[:12], 16) / 2.0**48
            ms.append(G.hypergeometric(u, left, marks, n))
            left, marks = left - n, marks - ms[-1]
        null.append(statistic(ms))
    row = (round(own, 9), round(sum(null) / len(null), 9), round(sum(v >= own - 1e-12 for v in null) / len(null), 9))
    return spark.createDataFrame([row], "statistic double, null_mean double, p double")


@q(
    "cluster_composition",
    sql=S.with_(V.SQL_WIDE, "k as (select label as cluster, dataset, count(*) as n, sum(y) as pos, sum(cast(cast(saplma >= 0 as int) = y as int)) as ok from wide group by all)")
    + "select cluster, cast(sum(n) as bigint) as n, round(sum(pos) / cast(sum(n) as double), 9) as rate, round(sum(ok) / cast(sum(n) as double), 9) as accuracy, arg_max(dataset, struct_pack(n := n, d := dataset)) as main_dataset, round(max(n) / cast(sum(n) as double), 9) as main_share from k group by all",
)
def cluster_composition(spark: SparkSession, d: str) -> DataFrame:
    """Size, rate, accuracy and main data set of each cluster."""
    k = V.wide(spark, d).groupBy(F.col("label").alias("cluster"), "dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), X.count_if((F.col("saplma") >= 0).cast("int") == F.col("y")).alias("ok"))
    return k.groupBy("cluster").agg(F.sum("n").alias("n"), out(F.sum("pos") / F.sum("n").cast("double")).alias("rate"), out(F.sum("ok") / F.sum("n").cast("double")).alias("accuracy"), F.max_by("dataset", F.struct("n", "dataset")).alias("main_dataset"), out(F.max("n") / F.sum("n").cast("double")).alias("main_share"))


def _pairs_of(c: str) -> F.Column:
    return F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)


@q(
    "ari",
    sql=S.with_(V.SQL_WIDE, "c as (select label as a, cast(floor(greatest(least(saplma, 1.9e0), -2e0) * 2) as int) as b, count(*) as n from wide group by all)", "i as (select sum(n * (n - 1e0) / 2) as s from c)", "x as (select sum(n * (n - 1e0) / 2) as s from (select sum(n) as n from c group by a))", "z as (select sum(n * (n - 1e0) / 2) as s from (select sum(n) as n from c group by b))", "t as (select sum(n) * (sum(n) - 1e0) / 2 as s from c)")
    + "select round((i.s - x.s * z.s / t.s) / nullif((x.s + z.s) / 2 - x.s * z.s / t.s, 0), 9) as ari from i, x, z, t",
)
def ari(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted Rand index of two partitions, from their contingency table."""
    b = F.floor(F.greatest(F.least(F.col("saplma"), F.lit(1.9)), F.lit(-2.0)) * 2).cast("int")
    c = V.wide(spark, d).groupBy(F.col("label").alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cells = c.agg(_pairs_of("n").alias("i"), (F.sum("n") * (F.sum("n") - 1.0) / 2).alias("t"))
    rows = c.groupBy("a").agg(F.sum("n").alias("n")).agg(_pairs_of("n").alias("x"))
    cols = c.groupBy("b").agg(F.sum("n").alias("n")).agg(_pairs_of("n").alias("z"))
    e = F.col("x") * F.col("z") / F.col("t")
    return cells.join(F.broadcast(rows)).join(F.broadcast(cols)).select(out((F.col("i") - e) / F.nullif((F.col("x") + F.col("z")) / 2 - e, F.lit(0.0))).alias("ari"))  # one row each


# Votes over the five methods of the wide view.


@q("vote_hard", sql=S.with_(SQL_FOLDED, "v as (select item_id, dataset, y, sum(pred) as k from emb group by all)", "r as (select unnest([{'rule': 'majority', 'least': 3}, {'rule': 'four', 'least': 4}, {'rule': 'unanimous', 'least': 5}], recursive := true), * from v)", f"c as (select rule, {S.confusion('y', 'cast(k >= least as int)')} from r group by all)") + f"select *, round({S.mcc()}, 9) as mcc from c")
def vote_hard(spark: SparkSession, d: str) -> DataFrame:
    """At least three, four or all of five decisions."""
    v = long_folded(spark, d).groupBy("item_id", "dataset", "y").agg(F.sum("pred").alias("k"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(k).alias("least")) for n, k in (("majority", 3), ("four", 4), ("unanimous", 5))])
    r = v.withColumn("r", F.explode(rules)).withColumn("pred", (F.col("k") >= F.col("r.least")).cast("int"))
    return r.groupBy(F.col("r.rule").alias("rule")).agg(*X.confusion()).select("*", out(X.mcc()).alias("mcc"))


_SOFT = "v as (select item_id, dataset, fold, y, round(avg(score), 12) as score from emb group by all)"
_RANKED = """
rk as (select *, (rank() over w + (count(*) over (partition by method, score) - 1) / 2e0) / count(*) over (partition by method) as rs from emb window w as (partition by method order by score)),
v as (select item_id, dataset, fold, y, round(avg(rs), 12) as score from rk group by all)"""
_APPLIED = "vm as (select 'vote' as method, * from v), " + sql_held_out("vm", "method") + ", ap as (select vm.*, cast(score >= t.threshold as int) as pred from vm join ho t using (method, fold)), sc as (select *, unnest(list_filter(['pooled', dataset, case when dataset <> 'coqa' then 'pooled_no_coqa' end], lambda x: x is not null)) as scope from ap), "


def soft(p: DataFrame) -> DataFrame:
    return p.groupBy("item_id", "dataset", "fold", "y").agg(F.round(F.avg("score"), 12).alias("score"))


def rank_mean(p: DataFrame) -> DataFrame:
    """Mean of average ranks, scaled on all rows of a method and never again on a part of them."""
    n = p.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    r = R.average_ranks(p, ["method"]).join(n, "method").select("method", "score", (F.col("avg_rank") / F.col("n")).alias("rs"))
    return p.join(r, ["method", "score"]).groupBy("item_id", "dataset", "fold", "y").agg(F.round(F.avg("rs"), 12).alias("score"))


def applied(v: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Decisions of a score by thresholds chosen on the other folds."""
    by = by or ["method"]
    v = cut(v if "method" in v.columns else v.withColumn("method", F.lit("vote")), "vote")  # read by two branches
    t = held_out_threshold(v, by)
    return v.join(t, [*by, "fold"]).withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))


def _vote_table(v: DataFrame) -> DataFrame:
    s = R.scoped(applied(v))
    c = s.groupBy("scope").agg(*X.confusion(), F.count(F.lit(1)).alias("n"))
    a = R.auroc(s, ["scope"]).select("scope", "auroc")
    return c.join(a, "scope").select("scope", "n", out("auroc").alias("auroc"), out(X.mcc()).alias("mcc"))


_VOTE_TABLE = f"c as (select scope, {S.confusion()}, count(*) as n from sc group by all), " + S.auroc("sc", "scope").strip()
_VOTE_OUT = f"select scope, n, round(auroc, 9) as auroc, round({S.mcc()}, 9) as mcc from c join roc using (scope)"


@q("vote_soft", sql=S.with_(SQL_FOLDED, _SOFT, _APPLIED + _VOTE_TABLE) + _VOTE_OUT)
def vote_soft(spark: SparkSession, d: str) -> DataFrame:
    """Mean score, with a threshold held out by folds."""
    return _vote_table(soft(long_folded(spark, d)))


@q("vote_rank", sql=S.with_(SQL_FOLDED, _RANKED, _APPLIED + _VOTE_TABLE) + _VOTE_OUT)
def vote_rank(spark: SparkSession, d: str) -> DataFrame:
    """Mean scaled rank, with a threshold held out by folds."""
    return _vote_table(rank_mean(long_folded(spark, d)))


@q("vote_without_anchor", sql=S.with_(SQL_FOLDED.replace("emb as (", "emb0 as ("), "emb as (select * from emb0 where method <> 'saplma')", _SOFT, _APPLIED + _VOTE_TABLE) + _VOTE_OUT)
def vote_without_anchor(spark: SparkSession, d: str) -> DataFrame:
    """The soft vote of the others."""
    return _vote_table(soft(long_folded(spark, d).filter("method <> 'saplma'")))


_ANCHOR_WRONG = "an as (select item_id, cast(saplma >= 0 as int) as pa from wide)"


@q(
    "vote_on_errors",
    sql=S.with_(SQL_FOLDED, "v as (select item_id, y, cast(sum(pred) >= 2 as int) as pred from emb where method <> 'saplma' group by all)", _ANCHOR_WRONG, "j as (select v.*, pa from v join an using (item_id))", "x as (select count(*) filter (where pa <> y) as n_errors, avg(cast(pred = y as int)) filter (where pa <> y) as rescue, avg(cast(pred = y as int)) filter (where y = 1) as acc1, avg(cast(pred = y as int)) filter (where y = 0) as acc0, avg(cast(y as double)) filter (where pa <> y) as mix1 from j)")
    + "select n_errors, round(rescue, 9) as rescue, round(acc1 * mix1 + acc0 * (1 - mix1), 9) as null_rate, round(rescue / nullif(acc1 * mix1 + acc0 * (1 - mix1), 0), 9) as ratio from x",
)
def vote_on_errors(spark: SparkSession, d: str) -> DataFrame:
    """The others' vote where the anchor errs, against the independence null."""
    p = long_folded(spark, d)
    v = p.groupBy("item_id", "y").agg(F.sum(F.when(F.col("method") != "saplma", F.col("pred"))).alias("k"), F.max(F.when(F.col("method") == "saplma", F.col("pred"))).alias("pa"))
    ok, wrong = ((F.col("k") >= 2).cast("int") == F.col("y")).cast("double"), F.col("pa") != F.col("y")
    x = v.agg(X.count_if(wrong).alias("n_errors"), F.avg(F.when(wrong, ok)).alias("rescue"), F.avg(F.when(F.col("y") == 1, ok)).alias("acc1"), F.avg(F.when(F.col("y") == 0, ok)).alias("acc0"), F.avg(F.when(wrong, F.col("y").cast("double"))).alias("mix1"))
    null = F.col("acc1") * F.col("mix1") + F.col("acc0") * (1 - F.col("mix1"))
    return x.select("n_errors", out("rescue").alias("rescue"), out(null).alias("null_rate"), out(X.ratio(F.col("rescue"), null)).alias("ratio"))


_BITS = "[" + ", ".join(f"{{'method': '{m}', 'bit': {1 << k}}}" for k, m in enumerate(V.METHODS)) + "]"


def subsets(w: DataFrame, ballots: dict[str, list[str]]) -> DataFrame:
    """(mask, k, dataset, fold, item_id, y, pred, and a mean per ballot): every non-empty subset of the methods.

    An item's methods stand in one row, so subsets are made inside it and nothing is shuffled per
    subset. ``pred`` is the strict majority; a ballot names a column for each method.
    """
    m = w.withColumn("mask", F.explode(F.sequence(F.lit(1), F.lit((1 << len(V.METHODS)) - 1))))
    inside = [F.col("mask").bitwiseAND(F.lit(1 << b)) > 0 for b in range(len(V.METHODS))]
    k = F.bit_count("mask")
    votes = X.total([(i & (F.col(c) >= 0)).cast("int") for i, c in zip(inside, V.METHODS, strict=True)])
    means = [F.round(X.total([F.when(i, F.col(c)).otherwise(0.0) for i, c in zip(inside, cols, strict=True)]) / k, 12).alias(n) for n, cols in ballots.items()]
    return m.select("mask", k.cast("long").alias("k"), "dataset", "fold", "item_id", "y", (2 * votes > k).cast("int").alias("pred"), *means)


_SUBSET = S.with_(
    SQL_FOLDED, f"b as (select unnest({_BITS}, recursive := true))",
    "rk as (select *, (rank() over w + (count(*) over (partition by method, score) - 1) / 2e0) / count(*) over (partition by method) as rs from emb window w as (partition by method order by score))",
    "sb as (select mask, rk.item_id, rk.dataset, rk.fold, rk.y, rk.pred, rk.score, rk.rs from rk join b using (method), (select unnest(range(1, 32)) as mask) where mask & bit > 0)",
    "v as (select mask, item_id, dataset, fold, y, cast(2 * sum(pred) > count(*) as int) as pred, round(avg(score), 12) as soft, round(avg(rs), 12) as rank, count(*) as k from sb group by all)",
)


@q(
    "subset_vote",
    sql=_SUBSET.rstrip() + ",\n" + ",\n".join(x.strip() for x in (
        "bl as (select mask, item_id, dataset, fold, y, unnest([{'ballot': 'soft', 'score': soft}, {'ballot': 'rank', 'score': rank}], recursive := true) from v)",
        sql_held_out("bl", "mask, ballot"),
        "ap as (select mask, ballot, dataset, y, score, cast(score >= threshold as int) as pred from bl join ho using (mask, ballot, fold) union all select mask, 'majority', dataset, y, null, pred from v)",
        S.scoped("ap"), f"c as (select scope, mask, ballot, {S.confusion()} from sc group by all)", S.auroc("sc", "scope, mask, ballot"),
    ))
    + f"\nselect scope, cast(mask as int) as mask, ballot, round({S.mcc()}, 9) as mcc, round(auroc, 9) as auroc from c left join roc using (scope, mask, ballot)",
)
def subset_vote(spark: SparkSession, d: str) -> DataFrame:
    """All 31 subsets of the five methods by strict majority, mean score and mean scaled rank, in each scope.

    The thresholds of the two mean ballots are chosen on the other folds.
    """
    w = folded(spark, d)
    p = cut(V.long(w), "scores")
    n = p.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    r = p.join(R.average_ranks(p, ["method"]), ["method", "score"]).join(F.broadcast(n), "method").withColumn("rs", F.col("avg_rank") / F.col("n"))  # a row per method
    of = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    ranked = r.groupBy("item_id", "dataset", "fold", "y").agg(*[of(m, "score").alias(m) for m in V.METHODS], *[of(m, "rs").alias(f"rs_{m}") for m in V.METHODS])
    v = cut(subsets(ranked, {"soft": list(V.METHODS), "rank": [f"rs_{m}" for m in V.METHODS]}), "subsets")
    bl = v.drop("pred").unpivot(["mask", "item_id", "dataset", "fold", "y"], ["soft", "rank"], "ballot", "score")
    t = held_out_threshold(bl, ["mask", "ballot"])
    ap = bl.join(F.broadcast(t), ["mask", "ballot", "fold"]).select("mask", "ballot", "dataset", "y", "score", (F.col("score") >= F.col("threshold")).cast("int").alias("pred"))  # a row per subset, ballot and fold
    every = ap.unionByName(v.select("mask", F.lit("majority").alias("ballot"), "dataset", "y", F.lit(None).cast("double").alias("score"), "pred"))
    c = R.scoped(every.groupBy("dataset", "mask", "ballot").agg(*X.confusion())).groupBy("scope", "mask", "ballot").agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn", "tn")])
    a = R.auroc(bl, ["scope", "mask", "ballot"]).select("scope", "mask", "ballot", "auroc")
    return c.join(a, ["scope", "mask", "ballot"], "left").select("scope", "mask", "ballot", out(X.mcc()).alias("mcc"), out("auroc").alias("auroc"))


@q(
    "subset_best",
    sql=S.with_(V.SQL_LONG, f"b as (select unnest({_BITS}, recursive := true))", "s as (select mask, emb.item_id, emb.y, emb.pred from emb join b using (method), (select unnest(range(1, 32)) as mask) where mask & bit > 0)", "v as (select mask, item_id, y, cast(2 * sum(pred) > count(*) as int) as pred, count(*) as k from s group by all)", f"c as (select mask, max(k) as k, {S.confusion()} from v group by all)", f"m as (select mask, k, round({S.mcc()}, 9) as m from c)")
    + "select k as n_methods, cast(arg_max(mask, struct_pack(m := m, x := -mask)) as int) as mask, max(m) as mcc from m group by k",
)
def subset_best(spark: SparkSession, d: str) -> DataFrame:
    """The best subset of each size; the lowest mask of equals."""
    m = subsets(V.wide(spark, d).withColumn("fold", F.lit(0)), {}).groupBy("mask").agg(F.max("k").alias("n_methods"), *X.confusion()).select("mask", "n_methods", out(X.mcc()).alias("m"))
    return m.groupBy("n_methods").agg(F.max_by("mask", F.struct("m", -F.col("mask"))).alias("mask"), F.max("m").alias("mcc"))


@q(
    "vote_k2_k3",
    sql=S.with_(V.SQL_LONG, "v as (select item_id, y, max(pred) filter (where method = 'saplma') as a, max(pred) filter (where method = 'lapeigvals') as b, max(pred) filter (where method = 'icr') as c from emb group by all)", "r as (select y, unnest([{'rule': 'k2_all', 'pred': least(a, b)}, {'rule': 'k2_any', 'pred': greatest(a, b)}, {'rule': 'k3_majority', 'pred': cast(a + b + c >= 2 as int)}], recursive := true) from v)", f"x as (select rule, {S.confusion()} from r group by all)") + f"select *, round({S.mcc()}, 9) as mcc from x",
)
def vote_k2_k3(spark: SparkSession, d: str) -> DataFrame:
    """Two voters by unanimity and by disjunction, three by majority."""
    w = V.wide(spark, d)
    a, b, c = ((F.col(m) >= 0).cast("int") for m in ("saplma", "lapeigvals", "icr"))
    rules = F.array(F.struct(F.lit("k2_all").alias("rule"), F.least(a, b).alias("pred")), F.struct(F.lit("k2_any").alias("rule"), F.greatest(a, b).alias("pred")), F.struct(F.lit("k3_majority").alias("rule"), ((a + b + c) >= 2).cast("int").alias("pred")))
    r = w.select("y", F.explode(rules).alias("r")).select("y", "r.*")
    return r.groupBy("rule").agg(*X.confusion()).select("*", out(X.mcc()).alias("mcc"))


@q(
    "best_single_frozen",
    sql=S.with_(V.SQL_PREDICTIONS, f"c as (select method, {S.confusion()} from pred group by all)", f"b as (select arg_max(method, struct_pack(m := round({S.mcc()}, 12), n := method)) as method from c)", "s as (select unnest(list_filter(['pooled', dataset, case when dataset <> 'coqa' then 'pooled_no_coqa' end], lambda x: x is not null)) as scope, * from pred where method = (select method from b))", f"x as (select scope, method, {S.confusion()} from s group by all)")
    + f"select scope, method, round({S.mcc()}, 9) as mcc from x",
)
def best_single_frozen(spark: SparkSession, d: str) -> DataFrame:
    """The method best on the pooled rows, then the same one in all scopes."""
    p = V.predictions(spark, d)
    best = p.groupBy("method").agg(*X.confusion()).agg(F.max_by("method", F.struct(F.round(X.mcc(), 12), "method")).alias("method"))
    x = R.scoped(p.join(F.broadcast(best), "method", "left_semi")).groupBy("scope", "method").agg(*X.confusion())
    return x.select("scope", "method", out(X.mcc()).alias("mcc"))


# Routing. The first method of the wide view is the anchor.

_HAND = ", ".join(f"{k / 50.0}e0" for k in range(31))


@q(
    "handoff",
    sql=S.with_(SQL_FOLDED, "p as (select item_id, fold, y, abs(saplma) as dist, cast(saplma >= 0 as int) as pa, cast(icr >= 0 as int) as pb from wf)", "f as (select distinct fold as held from p)", "t as (select held, unnest(quantile_cont(dist, [" + _HAND + "])) as t, unnest(range(31)) as k from p join f on p.fold <> f.held group by held)", f"c as (select t.held, t.k, t.t, {S.confusion('y', 'case when dist < t then pb else pa end')} from p join t on p.fold <> t.held group by all)", f"b as (select held as fold, arg_max(t, struct_pack(m := round({S.mcc()}, 12), k := -k)) as t from c group by all)", "a as (select p.y, case when dist < b.t then pb else pa end as pred, dist < b.t as handed from p join b using (fold))", f"x as (select count(*) as n, count(*) filter (where handed) as n_handed, {S.confusion()} from a)")
    + f"select n, n_handed, round({S.mcc()}, 9) as mcc from x",
)
def handoff(spark: SparkSession, d: str) -> DataFrame:
    """Unsure decisions go to a second method; how unsure is chosen on the other folds (31 quantiles)."""
    w = folded(spark, d).select("fold", "y", F.abs("saplma").alias("dist"), (F.col("saplma") >= 0).cast("int").alias("pa"), (F.col("icr") >= 0).cast("int").alias("pb"))
    w = cut(w, "hand")
    sums = {f"{m}_{k}": (F.col("y") == y) & (F.col(f"p{m}") == p) for m in "ab" for k, (y, p) in _CELL.items()}
    g = R.held_out_grid(w, [], "dist", sums, [k / 50.0 for k in range(31)])
    # Below the threshold the second method decides, from it on the first.
    g = g.select("held", "k", "t", *[(F.col(f"below_b_{k}") + F.col(f"total_a_{k}") - F.col(f"below_a_{k}")).alias(k) for k in _CELL])
    b = g.groupBy(F.col("held").alias("fold")).agg(F.max_by("t", F.struct(F.round(X.mcc(), 12), -F.col("k"))).alias("t"))
    a = w.join(F.broadcast(b), "fold").withColumn("handed", F.col("dist") < F.col("t")).withColumn("pred", F.when(F.col("handed"), F.col("pb")).otherwise(F.col("pa")))  # one row per fold
    return a.agg(F.count(F.lit(1)).alias("n"), X.count_if(F.col("handed")).alias("n_handed"), *X.confusion()).select("n", "n_handed", out(X.mcc()).alias("mcc"))


_CASC = [0.6 * k / 39.0 for k in range(40)]


@q(
    "cascade_score",
    sql=S.with_(
        SQL_FOLDED, "p as (select fold, y, cast(saplma >= 0 as int) as pa, icr as s from wf)", "f as (select distinct fold as held from p)",
        "t as (select held, unnest(quantile_cont(s, [" + ", ".join(f"{x!r}e0" for x in _CASC) + "])) as t, unnest(range(40)) as k from p join f on p.fold <> f.held where pa = 1 group by held)",
        f"c as (select t.held, t.k, t.t, {S.confusion('y', 'cast(pa = 1 and s >= t as int)')} from p join t on p.fold <> t.held group by all)",
        f"b as (select held as fold, arg_max(t, struct_pack(m := round({S.mcc()}, 12), k := -k)) as t from c group by all)",
        "a as (select p.y, pa, cast(pa = 1 and s >= b.t as int) as pred from p join b using (fold))",
        f"x as (select count(*) as n, count(*) filter (where pa <> pred) as n_demoted, {S.confusion()} from a)", f"o as (select {S.confusion('y', 'pa')} from a)", f"om as (select round({S.mcc()}, 9) as first from o)",
    )
    + f"select n, n_demoted, round({S.mcc()}, 9) as mcc, om.first as mcc_first_stage from x, om",
)
def cascade_score(spark: SparkSession, d: str) -> DataFrame:
    """A second stage that may only take back the first one's positives.

    Its threshold is the one of forty quantiles (0 … 0.6) of the positives' second scores on the other
    folds that gives the best MCC over all their rows.
    """
    p = cut(folded(spark, d).select("fold", "y", (F.col("saplma") >= 0).cast("int").alias("pa"), F.col("icr").alias("s")), "stages")
    g = R.held_out_grid(p.filter("pa = 1"), [], "s", {"pos": F.col("y") == 1, "neg": F.col("y") == 0}, _CASC)
    rest = p.filter("pa = 0").groupBy("fold").agg(X.count_if(F.col("y") == 1).alias("f1"), X.count_if(F.col("y") == 0).alias("f0"))  # never positive: misses and right ones
    every = rest.agg(F.sum("f1").alias("a1"), F.sum("f0").alias("a0"))
    g = g.join(F.broadcast(every)).join(F.broadcast(rest.withColumnRenamed("fold", "held")), "held", "left").na.fill(0, ["f1", "f0", "a1", "a0"])  # a row, a row per fold
    fn, tn = F.col("below_pos") + F.col("a1") - F.col("f1"), F.col("below_neg") + F.col("a0") - F.col("f0")
    g = g.select("held", "k", "t", (F.col("total_pos") - F.col("below_pos")).alias("tp"), (F.col("total_neg") - F.col("below_neg")).alias("fp"), fn.alias("fn"), tn.alias("tn"))
    b = g.groupBy(F.col("held").alias("fold")).agg(F.max_by("t", F.struct(F.round(X.mcc(), 12), -F.col("k"))).alias("t"))
    a = p.join(F.broadcast(b), "fold").withColumn("pred", ((F.col("pa") == 1) & (F.col("s") >= F.col("t"))).cast("int"))
    first = a.agg(*X.confusion("y", "pa")).select(out(X.mcc()).alias("mcc_first_stage"))
    x = a.agg(F.count(F.lit(1)).alias("n"), X.count_if(F.col("pa") != F.col("pred")).alias("n_demoted"), *X.confusion()).select("n", "n_demoted", out(X.mcc()).alias("mcc"))
    return x.join(F.broadcast(first))  # one row each


@q(
    "soft_blend",
    sql=S.with_(V.SQL_WIDE, "p as (select item_id, y, 1 / (1 + exp(-saplma)) as p, 1 / (1 + exp(-icr)) as w from wide)", "b as (select y, p * (1 - w) + (1 - p) * w as score, 'blend' as method from p union all select y, p, 'base' from p)", S.auroc("b", "method"), f"c as (select method, {S.confusion('y', 'cast(score >= 0.5e0 as int)')} from b group by all)")
    + f"select method, round(auroc, 9) as auroc, round({S.mcc()}, 9) as mcc from c join roc using (method)",
)
def soft_blend(spark: SparkSession, d: str) -> DataFrame:
    """A score turned over by the chance that it is wrong: p(1-w) + (1-p)w."""
    sig = lambda c: 1 / (1 + F.exp(-F.col(c)))
    p = V.wide(spark, d).select("y", sig("saplma").alias("p"), sig("icr").alias("w"))
    b = p.select("y", F.explode(F.array(F.struct(F.lit("blend").alias("method"), (F.col("p") * (1 - F.col("w")) + (1 - F.col("p")) * F.col("w")).alias("score")), F.struct(F.lit("base").alias("method"), F.col("p").alias("score")))).alias("b")).select("y", "b.*")
    c = b.withColumn("pred", (F.col("score") >= 0.5).cast("int")).groupBy("method").agg(*X.confusion())
    return c.join(R.auroc(b, ["method"]), "method").select("method", out("auroc").alias("auroc"), out(X.mcc()).alias("mcc"))


@q(
    "moe_combine",
    sql=S.with_(V.SQL_WIDE, "p as (select item_id, y, [%s] as s from wide)" % ", ".join(f"1 / (1 + exp(-{m}))" for m in V.METHODS), "g as (select *, list_transform(s, lambda x: exp(abs(x - 0.5e0) * 4)) as e from p)", "r as (select y, unnest([{'rule': 'mean', 'score': list_sum(s) / 5}, {'rule': 'max', 'score': list_max(s)}, {'rule': 'gated', 'score': list_sum(list_transform(range(1, 6), lambda k: s[k] * e[k])) / list_sum(e)}, {'rule': 'majority', 'score': len(list_filter(s, lambda x: x >= 0.5e0)) / 5e0}], recursive := true) from g)", "r2 as (select rule, y, round(score, 12) as score from r)", S.auroc("r2", "rule"), f"c as (select rule, {S.confusion('y', 'cast(score >= 0.5e0 as int)')} from r2 group by all)")
    + f"select rule, round(auroc, 9) as auroc, round({S.mcc()}, 9) as mcc from c join roc using (rule)",
)
def moe_combine(spark: SparkSession, d: str) -> DataFrame:
    """Experts' scores by mean, maximum, a gate (softmax of sureness) and majority."""
    s = F.array(*[1 / (1 + F.exp(-F.col(m))) for m in V.METHODS])
    p = V.wide(spark, d).select("y", s.alias("s")).withColumn("e", F.transform("s", lambda x: F.exp(F.abs(x - 0.5) * 4)))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    rules = [("mean", add(F.col("s")) / 5), ("max", F.array_max("s")), ("gated", X.dot("s", "e") / add(F.col("e"))), ("majority", F.size(F.filter("s", lambda x: x >= 0.5)) / 5.0)]
    r = p.select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.round(c, 12).alias("score")) for n, c in rules])).alias("r")).select("y", "r.*")
    c = r.withColumn("pred", (F.col("score") >= 0.5).cast("int")).groupBy("rule").agg(*X.confusion())
    return c.join(R.auroc(r, ["rule"]), "rule").select("rule", out("auroc").alias("auroc"), out(X.mcc()).alias("mcc"))


@q(
    "transfer_cells",
    sql=S.with_(V.SQL_LONG, S.threshold("emb", "dataset, method"), "x as (select s.dataset as source, t.dataset as target, t.method, t.y, t.score, s.threshold from thr s join emb t using (method))", f"c as (select source, target, method, {S.confusion('y', 'cast(score >= threshold as int)')} from x group by all)")
    + f"select c.source, c.target, c.method, round({S.mcc()}, 9) as mcc, round(o.mcc, 9) as mcc_refit from c join thr o on o.dataset = c.target and o.method = c.method",
)
def transfer_cells(spark: SparkSession, d: str) -> DataFrame:
    """MCC on each target with each source's threshold, beside the threshold refitted on the target."""
    p = V.long(V.wide(spark, d))
    t = R.best_threshold(p, ["dataset", "method"])
    src = t.select(F.col("dataset").alias("source"), "method", "threshold")
    x = p.withColumnRenamed("dataset", "target").join(src, "method").withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))
    c = x.groupBy("source", "target", "method").agg(*X.confusion())
    refit = t.select(F.col("dataset").alias("target"), "method", F.col("mcc").alias("r"))
    return c.join(refit, ["target", "method"]).select("source", "target", "method", out(X.mcc()).alias("mcc"), out("r").alias("mcc_refit"))


@q("sigmoid_scores", sql=S.with_(V.SQL_LONG) + "select item_id, method, round(1 / (1 + exp(-score)), 9) as p from emb")
def sigmoid_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores brought to 0 … 1."""
    return V.long(V.wide(spark, d)).select("item_id", "method", out(1 / (1 + F.exp(-F.col("score")))).alias("p"))


@q("univariate_auroc", sql=S.with_(V.SQL_LONG, S.auroc("emb", "method")) + "select method, n_pos, n_neg, round(auroc, 9) as auroc, round(greatest(auroc, 1 - auroc), 9) as strength from roc")
def univariate_auroc(spark: SparkSession, d: str) -> DataFrame:
    """AUROC of every single column."""
    a = R.auroc(V.long(V.wide(spark, d)), ["method"])
    return a.select("method", "n_pos", "n_neg", out("auroc").alias("auroc"), out(F.greatest(F.col("auroc"), 1 - F.col("auroc"))).alias("strength"))
