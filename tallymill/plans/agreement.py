"""How methods and judges agree, disagree and complete one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.functions import expressions as X
from tallymill.functions import sqltext as S
from tallymill.functions.expressions import out
from tallymill.operators import paired as P
from tallymill.operators import ranked as R
from tallymill.plans.metrics import answers_by_item
from tallymill.registry import CORE
from tallymill.session import cut
from tallymill.sources import views as V

q = CORE.query
ITEM = ["run", "seed", "fold", "dataset", "item_id", "y"]


def _right(s: str) -> Column:
    return F.col(f"{s}.pred") == F.col("y")


def decided(spark: SparkSession, d: str) -> DataFrame:
    return V.predictions(spark, d).filter("pred is not null")


def pair_rows(spark: SparkSession, d: str, ordered: bool = False, with_score: bool = False) -> DataFrame:
    return P.method_pairs(decided(spark, d), ITEM, ["pred", *(["score"] if with_score else [])], ordered)


_PAIRS = """
dec as (select * from pred where pred is not null),
pr as (select a.run, a.seed, a.fold, a.dataset, a.item_id, a.y, a.method as ma, b.method as mb, a.pred as pa, b.pred as pb, a.score as sa, b.score as sb
       from dec a join dec b on a.run = b.run and a.seed = b.seed and a.fold = b.fold and a.item_id = b.item_id and a.dataset = b.dataset and a.y = b.y and {on})"""
SQL_PAIRS = _PAIRS.format(on="a.method < b.method")
SQL_ORDERED = _PAIRS.format(on="a.method <> b.method")
_CELLS = "count(*) filter (where pa = 1 and pb = 1) as n11, count(*) filter (where pa = 1 and pb = 0) as n10, count(*) filter (where pa = 0 and pb = 1) as n01, count(*) filter (where pa = 0 and pb = 0) as n00"


def _cells() -> list[Column]:
    a, b = F.col("a.pred"), F.col("b.pred")
    return [F.sum(((a == i) & (b == j)).cast("long")).alias(f"n{i}{j}") for i in (1, 0) for j in (1, 0)]


@q(
    "kappa_pairs",
    sql=S.with_(V.SQL_PREDICTIONS, SQL_PAIRS, f"c as (select unnest(list_filter(['pooled', dataset, case when dataset <> 'coqa' then 'pooled_no_coqa' end], lambda x: x is not null)) as scope, ma, mb, pa, pb from pr)", f"k as (select scope, ma as method_a, mb as method_b, count(*) as n, {_CELLS} from c group by all)")
    + f"select scope, method_a, method_b, n, round((n11 + n00) / cast(n as double), 9) as agreement, round({S.kappa('n11', 'n10', 'n01', 'n00')}, 9) as kappa from k",
)
def kappa_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Agreement and kappa of each pair of methods, in every scope; null where both decide one way only."""
    rows = R.scoped(pair_rows(spark, d))
    k = rows.groupBy("scope", F.col("a.method").alias("method_a"), F.col("b.method").alias("method_b")).agg(F.count(F.lit(1)).alias("n"), *_cells())
    return k.select("scope", "method_a", "method_b", "n", out((F.col("n11") + F.col("n00")) / F.col("n").cast("double")).alias("agreement"), out(X.kappa("n11", "n10", "n01", "n00")).alias("kappa"))


_DISCORD = "count(*) filter (where pa = y and pb <> y) as b, count(*) filter (where pa <> y and pb = y) as c"


def discordant(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    rows = pair_rows(spark, d)
    return rows.groupBy(*by, F.col("a.method").alias("method_a"), F.col("b.method").alias("method_b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((_right("a") & ~_right("b")).cast("long")).alias("b"), F.sum((~_right("a") & _right("b")).cast("long")).alias("c")
    )


@q(
    "mcnemar_pairs",
    sql=S.with_(V.SQL_PREDICTIONS, SQL_PAIRS, f"m as (select ma as method_a, mb as method_b, count(*) as n, {_DISCORD} from pr group by all)")
    + f"select *, b + c as discordant, round(case when b + c >= 25 then power(abs(b - c) - 1e0, 2) / (b + c) end, 9) as statistic, round({P.sql_mcnemar_p('b', 'c')}, 6) as p from m",
)
def mcnemar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Discordant counts, statistic and p of each pair of methods."""
    m = discordant(spark, d, [])
    b, c = F.col("b"), F.col("c")
    return m.select("*", (b + c).alias("discordant"), out(P.mcnemar_statistic(b, c)).alias("statistic"), F.round(P.mcnemar_p(b, c), 6).alias("p"))


@q(
    "holm",
    sql=S.with_(
        V.SQL_PREDICTIONS, SQL_PAIRS, f"m as (select ma as method_a, mb as method_b, {_DISCORD} from pr group by all)",
        f"v as (select method_a, method_b, {P.sql_mcnemar_p('b', 'c')} as p from m)",
        "r as (select *, row_number() over (order by p, method_a, method_b) as k, count(*) over () as n from v)",
    )
    + "select method_a, method_b, round(p, 6) as p, round(least(1e0, max((n - k + 1) * p) over (order by k rows unbounded preceding)), 6) as p_adjusted, least(1e0, max((n - k + 1) * p) over (order by k rows unbounded preceding)) < 0.05 as significant from r",
)
def holm(spark: SparkSession, d: str) -> DataFrame:
    """Step-down adjusted p of all pairs of methods."""
    v = discordant(spark, d, []).select("method_a", "method_b", P.mcnemar_p(F.col("b"), F.col("c")).alias("p"))
    h = P.holm(v, [], "p", ["method_a", "method_b"])
    return h.select("method_a", "method_b", F.round("p", 6).alias("p"), F.round("p_adjusted", 6).alias("p_adjusted"), (F.col("p_adjusted") < 0.05).alias("significant"))


@q(
    "most_complementary",
    sql=S.with_(V.SQL_PREDICTIONS, SQL_PAIRS, f"k as (select seed, ma as method_a, mb as method_b, {_CELLS} from pr group by all)", f"s as (select method_a, method_b, {S.kappa('n11', 'n10', 'n01', 'n00')} as k from k)")
    + "select method_a, method_b, count(k) as n_seeds, round(avg(k), 9) as kappa_mean, round(stddev_pop(k), 9) as kappa_std from s group by all having avg(k) is not null order by avg(k), method_a, method_b limit 5",
)
def most_complementary(spark: SparkSession, d: str) -> DataFrame:
    """The five pairs with the lowest mean kappa over seeds; pairs without one are left out."""
    k = pair_rows(spark, d).groupBy("seed", F.col("a.method").alias("method_a"), F.col("b.method").alias("method_b")).agg(*_cells())
    k = k.select("method_a", "method_b", X.kappa("n11", "n10", "n01", "n00").alias("k"))
    k = k.groupBy("method_a", "method_b").agg(F.count("k").alias("n_seeds"), F.avg("k").alias("m"), F.stddev_pop("k").alias("s")).filter("m is not null")
    return k.orderBy("m", "method_a", "method_b").limit(5).select("method_a", "method_b", "n_seeds", out("m").alias("kappa_mean"), out("s").alias("kappa_std"))


@q(
    "judge_agreement",
    sql=S.with_(
        V.SQL_VOTES,
        "j as (select a.judge as judge_a, b.judge as judge_b, a.label as la, b.label as lb from votes a join votes b on a.item_id = b.item_id and a.judge < b.judge)",
        "n as (select judge_a, judge_b, count(*) as n, avg(cast(la = lb as int)) as po from j group by all)",
        "x as (select judge_a, judge_b, la as label, count(*) as k, 0 as side from j group by all union all select judge_a, judge_b, lb, count(*), 1 from j group by all)",
        "e as (select judge_a, judge_b, label, sum(k) filter (where side = 0) as ka, sum(k) filter (where side = 1) as kb from x group by all)",
        "c as (select judge_a, judge_b, sum(coalesce(ka, 0) * cast(coalesce(kb, 0) as double)) as s, count(*) as labels from e group by all)",
    )
    + "select judge_a, judge_b, n, round(po, 9) as agreement, round(case when n > 1 and labels > 1 then (po - s / n / n) / nullif(1 - s / n / n, 0) end, 9) as kappa from n join c using (judge_a, judge_b)",
)
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Raw agreement and four-valued kappa of each pair of judges."""
    v = V.votes(spark, d).select("item_id", F.col("judge").alias("method"), "label")
    j = P.method_pairs(v, ["item_id"], ["label"]).select(F.col("a.method").alias("judge_a"), F.col("b.method").alias("judge_b"), F.col("a.label").alias("la"), F.col("b.label").alias("lb"))
    cells = j.groupBy("judge_a", "judge_b", "la", "lb").agg(F.count(F.lit(1)).alias("k"))
    by = ["judge_a", "judge_b"]
    labels = ("HALLUCINATED", "NOT_HALLUCINATED", "INVALID", "UNPARSEABLE")
    margin = lambda c, x: F.sum(F.when(F.col(c) == x, F.col("k")).otherwise(0)).cast("double")
    agg = cells.groupBy(*by).agg(
        F.sum("k").alias("n"), (F.sum(F.when(F.col("la") == F.col("lb"), F.col("k")).otherwise(0)) / F.sum("k")).alias("po"),
        X.total([margin("la", x) * margin("lb", x) for x in labels]).alias("s"),
        X.total([((margin("la", x) + margin("lb", x)) > 0).cast("int") for x in labels]).alias("labels"),
    )
    pe = F.col("s") / F.col("n") / F.col("n")
    kappa = F.when((F.col("n") > 1) & (F.col("labels") > 1), (F.col("po") - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return agg.select(*by, "n", out("po").alias("agreement"), out(kappa).alias("kappa"))


def majority(votes: DataFrame) -> DataFrame:
    """(item_id, n_judges, label, n_agreeing, unanimous, scored): a strict majority, else INVALID."""
    per = votes.groupBy("item_id", "label").agg(F.count(F.lit(1)).alias("k"))
    top = per.groupBy("item_id").agg(F.sum("k").alias("n_judges"), F.max("k").alias("n_agreeing"), F.max_by("label", F.struct("k", "label")).alias("first"), (F.count(F.lit(1)) == 1).alias("unanimous"))
    label = F.when(2 * F.col("n_agreeing") > F.col("n_judges"), F.col("first")).otherwise("INVALID")
    return top.select("item_id", "n_judges", label.alias("label"), "n_agreeing", "unanimous").withColumn("scored", F.col("label").isin("HALLUCINATED", "NOT_HALLUCINATED"))


SQL_MAJORITY = V.SQL_VOTES + """,
per as (select item_id, label, count(*) as k from votes group by all),
top as (select item_id, cast(sum(k) as bigint) as n_judges, max(k) as n_agreeing, arg_max(label, struct_pack(k := k, l := label)) as first, count(*) = 1 as unanimous from per group by all),
maj as (select item_id, n_judges, case when 2 * n_agreeing > n_judges then first else 'INVALID' end as label, n_agreeing, unanimous from top),
lab as (select *, label in ('HALLUCINATED', 'NOT_HALLUCINATED') as scored from maj)"""


# The judges that a vote needs: here the three that label most items.
_PANEL = "panel as (select judge from votes group by judge order by count(*) desc, judge limit 3)"


def panel(votes: DataFrame, size: int = 3) -> DataFrame:
    return votes.groupBy("judge").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "judge").limit(size).select("judge")


def complete(votes: DataFrame, judges: DataFrame) -> DataFrame:
    """Votes of the judges on items that every one of them has labelled."""
    own = votes.join(F.broadcast(judges), "judge", "left_semi")  # a row per judge
    n = judges.agg(F.count(F.lit(1)).alias("n"))
    full = own.groupBy("item_id").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n)).filter("k = n").select("item_id")  # one row
    return own.join(full, "item_id", "left_semi")


@q(
    "vote_majority",
    sql=S.with_(V.SQL_VOTES, _PANEL, "full_ as (select item_id from votes where judge in (select judge from panel) group by item_id having count(*) = (select count(*) from panel))", SQL_MAJORITY.replace(V.SQL_VOTES + ",", "").replace("from votes group by all", "from votes where judge in (select judge from panel) and item_id in (select item_id from full_) group by all")) + "select * from lab",
)
def vote_majority(spark: SparkSession, d: str) -> DataFrame:
    """The majority label of the items that every judge of the panel has labelled; no strict majority makes it INVALID."""
    v = V.votes(spark, d)
    return majority(complete(v, panel(v)))


@q(
    "label_summary",
    sql=S.with_(SQL_MAJORITY, "i as (select distinct item_id from items where item_id is not null)")
    + """select split_part(i.item_id, ':', 1) as dataset, count(*) as n_items, count(l.item_id) as n_labelled, count(*) filter (where scored) as n_scored,
           count(*) filter (where not scored) as n_dropped, round(count(*) filter (where label = 'HALLUCINATED') / nullif(cast(count(*) filter (where scored) as double), 0), 9) as hallucination_rate
         from i left join lab l using (item_id) group by 1""",
)
def label_summary(spark: SparkSession, d: str) -> DataFrame:
    """Items, labelled, scored and dropped items by data set, and the rate among the scored."""
    from tallymill.sources.tables import table

    items = table(spark, d, "items", "item_id").filter("item_id is not null").distinct()
    lab = majority(V.votes(spark, d)).select("item_id", "label", "scored")
    rows = items.join(lab, "item_id", "left").groupBy(V.item_dataset(F.col("item_id")).alias("dataset"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_items"), F.count("label").alias("n_labelled"), F.coalesce(X.count_if(F.col("scored")), F.lit(0)).alias("n_scored"),
        F.coalesce(X.count_if(~F.col("scored")), F.lit(0)).alias("n_dropped"),
        out(X.ratio(X.count_if(F.col("label") == "HALLUCINATED"), X.count_if(F.col("scored")))).alias("hallucination_rate"),
    )


@q(
    "oracle_bound",
    sql=S.with_(V.SQL_PREDICTIONS, "o as (select run, seed, fold, dataset, item_id, y, bool_or(pred = y) as any_right, count(*) as k from pred where pred is not null and not starts_with(method, 'union') group by all)", "s as (select unnest(list_filter(['pooled', dataset, case when dataset <> 'coqa' then 'pooled_no_coqa' end], lambda x: x is not null)) as scope, y, case when any_right then y else 1 - y end as pred, any_right from o)", f"c as (select scope, count(*) as n, avg(cast(any_right as int)) as coverage, {S.confusion()} from s group by all)")
    + f"select scope, n, round(coverage, 9) as coverage, round({S.mcc()}, 9) as oracle_mcc from c",
)
def oracle_bound(spark: SparkSession, d: str) -> DataFrame:
    """Share of items that any base method gets right, and the MCC of that oracle."""
    o = decided(spark, d).filter(~F.col("method").startswith("union")).groupBy(*ITEM).agg(F.bool_or(F.col("pred") == F.col("y")).alias("any_right"))
    s = R.scoped(o.withColumn("pred", F.when(F.col("any_right"), F.col("y")).otherwise(1 - F.col("y"))))
    c = s.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("any_right").cast("int")).alias("coverage"), *X.confusion())
    return c.select("scope", "n", out("coverage").alias("coverage"), out(X.mcc()).alias("oracle_mcc"))


_RESCUE = f"""
sp as (select *, {S.SCOPES} as scope from pr),
cls as (select scope, ma, mb, count(*) as n, avg(cast(pb = y as int)) filter (where y = 1) as acc1, avg(cast(pb = y as int)) filter (where y = 0) as acc0,
          avg(cast(pa = y as int)) as acc_a, count(*) filter (where pa <> y) as n_wrong, avg(cast(pb = y as int)) filter (where pa <> y) as rescue,
          avg(cast(y as double)) filter (where pa <> y) as mix1,
          count(*) filter (where pa <> y and y = 1 and pb = 1) as n11, count(*) filter (where pa <> y and y = 1 and pb = 0) as n10,
          count(*) filter (where pa <> y and y = 0 and pb = 1) as n01, count(*) filter (where pa <> y and y = 0 and pb = 0) as n00 from sp group by all),
res as (select scope, ma as anchor, mb as other, n, n_wrong, acc_a, rescue, acc1 * mix1 + acc0 * (1 - mix1) as null_rate, {S.kappa('n11', 'n10', 'n01', 'n00')} as kappa
        from cls where n_wrong >= 20 and mix1 > 0 and mix1 < 1)"""


def rescues(pairs: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """How often the other method is right where the anchor is wrong, and what independence would give.

    The null mixes the other method's accuracy by class with the classes among the anchor's errors;
    kappa is between label and other method on these errors. Errors of one class, or few, are left out.
    """
    wrong, right = ~_right("a"), _right("b").cast("double")
    cells = [X.count_if(wrong & (F.col("y") == i) & (F.col("b.pred") == j)).alias(f"n{i}{j}") for i in (1, 0) for j in (1, 0)]
    c = pairs.groupBy(*by, F.col("a.method").alias("anchor"), F.col("b.method").alias("other")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("y") == 1, right)).alias("acc1"), F.avg(F.when(F.col("y") == 0, right)).alias("acc0"),
        F.avg(_right("a").cast("double")).alias("acc_a"), X.count_if(wrong).alias("n_wrong"), F.avg(F.when(wrong, right)).alias("rescue"), F.avg(F.when(wrong, F.col("y").cast("double"))).alias("mix1"), *cells,
    )
    null = F.col("acc1") * F.col("mix1") + F.col("acc0") * (1 - F.col("mix1"))
    c = c.filter((F.col("n_wrong") >= least) & (F.col("mix1") > 0) & (F.col("mix1") < 1))
    return c.select(*by, "anchor", "other", "n", "n_wrong", "acc_a", "rescue", null.alias("null_rate"), X.kappa("n11", "n10", "n01", "n00").alias("kappa"))


@q(
    "rescue_null",
    sql=S.with_(V.SQL_PREDICTIONS, SQL_ORDERED, _RESCUE) + "select scope, anchor, other, n, n_wrong, round(rescue, 9) as rescue, round(null_rate, 9) as null_rate, round(rescue / nullif(null_rate, 0), 9) as ratio, round(kappa, 9) as kappa from res",
)
def rescue_null(spark: SparkSession, d: str) -> DataFrame:
    """Conditional rescue against the independence null, for ordered pairs of methods in each scope."""
    r = rescues(R.scoped(pair_rows(spark, d, ordered=True)), ["scope"])
    return r.select("scope", "anchor", "other", "n", "n_wrong", out("rescue").alias("rescue"), out("null_rate").alias("null_rate"), out(X.ratio(F.col("rescue"), F.col("null_rate"))).alias("ratio"), out("kappa").alias("kappa"))


@q(
    "independence_tradeoff",
    sql=S.with_(
        V.SQL_PREDICTIONS, SQL_ORDERED, _RESCUE, "t as (select acc_a, rescue / nullif(null_rate, 0) as ratio from res where scope = 'pooled' and null_rate > 0)",
        "k as (select ratio, rank() over (order by round(acc_a, 12)) + (count(*) over (partition by round(acc_a, 12)) - 1) / 2e0 as ra, rank() over (order by round(ratio, 12)) + (count(*) over (partition by round(ratio, 12)) - 1) / 2e0 as rr from t)",
    )
    + "select count(*) as n_pairs, round(avg(cast(ratio < 1 as int)), 9) as share_below_1, round(max(ratio), 9) as max_ratio, round(corr(ra, rr), 9) as spearman from k",
)
def independence_tradeoff(spark: SparkSession, d: str) -> DataFrame:
    """Over pairs: rank correlation of the anchor's accuracy with the rescue ratio, and how many fall below 1."""
    t = rescues(pair_rows(spark, d, ordered=True), []).filter("null_rate > 0")
    t = t.select(F.round("acc_a", 12).alias("acc"), F.round(F.col("rescue") / F.col("null_rate"), 12).alias("ratio"))
    t = cut(t.withColumn("one", F.lit(1)), "pairs")
    for c, r in (("acc", "ra"), ("ratio", "rr")):
        t = t.join(R.average_ranks(t, ["one"], c).select("one", c, F.col("avg_rank").alias(r)), ["one", c])
    return t.agg(F.count(F.lit(1)).alias("n_pairs"), out(F.avg((F.col("ratio") < 1).cast("int"))).alias("share_below_1"), out(F.max("ratio")).alias("max_ratio"), out(F.corr("ra", "rr")).alias("spearman"))


ANCHOR = "saplma"


@q(
    "kappa_by_population",
    sql=S.with_(
        V.SQL_PREDICTIONS,
        "an as (select run, seed, fold, item_id, pred = y as ok from pred where method = 'saplma' and pred is not null)",
        f"w as (select p.*, an.ok, {S.SCOPES} as scope from pred p join an using (run, seed, fold, item_id) where p.pred is not null)",
        "u as (select scope, method, y, pred, unnest(['all', case when ok then 'anchor_right' else 'anchor_wrong' end]) as population from w)",
        "k as (select scope, population, method, count(*) as n, avg(cast(y as double)) as rate, avg(cast(pred = y as int)) as acc, min(pred) = max(pred) as one, "
        + ", ".join(f"count(*) filter (where y = {i} and pred = {j}) as n{i}{j}" for i in (1, 0) for j in (1, 0)) + " from u group by all having count(*) >= 20 and min(y) <> max(y))",
    )
    + f"select scope, population, method, n, round(rate, 9) as positive_rate, round(acc, 9) as accuracy, round(case when one then 0e0 else {S.kappa('n11', 'n10', 'n01', 'n00')} end, 9) as kappa from k",
)
def kappa_by_population(spark: SparkSession, d: str) -> DataFrame:
    """Kappa of each method against the label over all items, and where the anchor is right or wrong, by scope.

    Populations of 20 items or more with both labels; a method that decides one way has kappa 0.
    """
    rows = decided(spark, d).groupBy(*ITEM).agg(F.collect_list(F.struct("method", "pred")).alias("m"), F.max(F.when(F.col("method") == ANCHOR, F.col("pred") == F.col("y"))).alias("ok")).filter("ok is not null")
    u = R.scoped(rows).select("scope", "y", F.explode(F.array(F.lit("all"), F.when(F.col("ok"), "anchor_right").otherwise("anchor_wrong"))).alias("population"), "m").select("scope", "population", "y", F.explode("m").alias("p")).select("scope", "population", "y", "p.*")
    cells = [X.count_if((F.col("y") == i) & (F.col("pred") == j)).alias(f"n{i}{j}") for i in (1, 0) for j in (1, 0)]
    k = u.groupBy("scope", "population", "method").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("rate"), F.avg((F.col("pred") == F.col("y")).cast("int")).alias("acc"), (F.min("pred") == F.max("pred")).alias("one"), R.two_classes().alias("two"), *cells)
    kappa = F.when(F.col("one"), 0.0).otherwise(X.kappa("n11", "n10", "n01", "n00"))
    return k.filter("two and n >= 20").select("scope", "population", "method", "n", out("rate").alias("positive_rate"), out("acc").alias("accuracy"), out(kappa).alias("kappa"))


@q(
    "union_transfer",
    sql=S.with_(V.SQL_PREDICTIONS, SQL_ORDERED)
    + """select ma as base, mb as other, count(*) as n, count(*) filter (where pa = y and pb = y) as retained, count(*) filter (where pa = y and pb <> y) as lost,
           count(*) filter (where pa <> y and pb = y) as fixed, count(*) filter (where pa <> y and pb <> y) as inherited from pr where mb = 'union_equal' group by all""",
)
def union_transfer(spark: SparkSession, d: str) -> DataFrame:
    """What the union keeps, loses, fixes and inherits of each method's decisions."""
    r = pair_rows(spark, d, ordered=True).filter(F.col("b.method") == "union_equal")
    a, b = _right("a"), _right("b")
    return r.groupBy(F.col("a.method").alias("base"), F.col("b.method").alias("other")).agg(
        F.count(F.lit(1)).alias("n"), X.count_if(a & b).alias("retained"), X.count_if(a & ~b).alias("lost"), X.count_if(~a & b).alias("fixed"), X.count_if(~a & ~b).alias("inherited")
    )


_ITEMS_RIGHT = """
it as (select run, seed, fold, dataset, item_id, y, max(cast(pred = y as int)) filter (where method = 'saplma') as anchor_right,
         count(*) filter (where pred = y) as n_right, count(*) filter (where pred = y and method <> 'saplma') as others_right, count(*) as k
       from pred where pred is not null and not starts_with(method, 'union') group by all)"""


def items_right(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("pred") == F.col("y")
    rows = decided(spark, d).filter(~F.col("method").startswith("union")).groupBy(*ITEM)
    return rows.agg(
        F.max(F.when(F.col("method") == ANCHOR, ok.cast("int"))).alias("anchor_right"), X.count_if(ok).alias("n_right"),
        X.count_if(ok & (F.col("method") != ANCHOR)).alias("others_right"), F.count(F.lit(1)).alias("k"),
    )


@q(
    "headroom",
    sql=S.with_(V.SQL_PREDICTIONS, _ITEMS_RIGHT, "s as (select unnest(list_filter(['pooled', dataset, case when dataset <> 'coqa' then 'pooled_no_coqa' end], lambda x: x is not null)) as scope, *, case when anchor_right = 1 or others_right > 0 then y else 1 - y end as pred from it where anchor_right is not null)", f"c as (select scope, count(*) as n, count(*) filter (where anchor_right = 0) as n_wrong, count(*) filter (where anchor_right = 0 and others_right > 0) as rescued, count(*) filter (where anchor_right = 0 and others_right = 1) as reached_by_one, count(*) filter (where anchor_right = 1 and others_right = 0) as only_anchor, {S.confusion()} from s group by all)")
    + f"select scope, n, n_wrong, rescued, reached_by_one, only_anchor, round(rescued / nullif(cast(n_wrong as double), 0), 9) as exploitable, round({S.mcc()}, 9) as ceiling_mcc from c",
)
def headroom(spark: SparkSession, d: str) -> DataFrame:
    """How many of the anchor's errors others get right, and the MCC if all were used."""
    s = items_right(spark, d).filter("anchor_right is not null")
    s = R.scoped(s.withColumn("pred", F.when((F.col("anchor_right") == 1) | (F.col("others_right") > 0), F.col("y")).otherwise(1 - F.col("y"))))
    wrong = F.col("anchor_right") == 0
    c = s.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), X.count_if(wrong).alias("n_wrong"), X.count_if(wrong & (F.col("others_right") > 0)).alias("rescued"),
        X.count_if(wrong & (F.col("others_right") == 1)).alias("reached_by_one"), X.count_if(~wrong & (F.col("others_right") == 0)).alias("only_anchor"), *X.confusion(),
    )
    return c.select("scope", "n", "n_wrong", "rescued", "reached_by_one", "only_anchor", out(X.ratio(F.col("rescued"), F.col("n_wrong"))).alias("exploitable"), out(X.mcc()).alias("ceiling_mcc"))


@q(
    "win_overlap",
    sql=S.with_(V.SQL_PREDICTIONS, SQL_PAIRS, "w as (select ma as method_a, mb as method_b, count(*) filter (where pa = y) as n_a, count(*) filter (where pb = y) as n_b, count(*) filter (where pa = y and pb = y) as n_both, count(*) filter (where pa = y or pb = y) as n_any from pr group by all)")
    + "select method_a, method_b, n_a, n_b, n_both, n_a - n_both as only_a, n_b - n_both as only_b, round(n_both / nullif(cast(n_any as double), 0), 9) as jaccard, round(n_both / nullif(cast(n_a as double), 0), 9) as share_of_a from w",
)
def win_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Sets of items two methods get right: sizes, differences, Jaccard, share of the first in the second."""
    a, b = _right("a"), _right("b")
    w = pair_rows(spark, d).groupBy(F.col("a.method").alias("method_a"), F.col("b.method").alias("method_b")).agg(
        X.count_if(a).alias("n_a"), X.count_if(b).alias("n_b"), X.count_if(a & b).alias("n_both"), X.count_if(a | b).alias("n_any")
    )
    return w.select("method_a", "method_b", "n_a", "n_b", "n_both", (F.col("n_a") - F.col("n_both")).alias("only_a"), (F.col("n_b") - F.col("n_both")).alias("only_b"), out(X.ratio(F.col("n_both"), F.col("n_any"))).alias("jaccard"), out(X.ratio(F.col("n_both"), F.col("n_a"))).alias("share_of_a"))


_ALIGNED = "al as (select run, seed, item_id, bool_or(source = 'charm') as second from pred where source in ('published', 'charm') group by all having bool_or(source = 'published'))"


@q(
    "align_methods",
    sql=S.with_(V.SQL_PREDICTIONS, _ALIGNED) + "select p.run, p.seed, p.fold, p.dataset, p.item_id, p.y, p.source, p.method, round(p.score, 9) as score, p.pred from pred p join al using (run, seed, item_id) where second and source in ('published', 'charm')",
)
def align_methods(spark: SparkSession, d: str) -> DataFrame:
    """The predictions of both sources on the base items that the second one has too; other items drop out of all methods."""
    p = V.predictions(spark, d).filter(F.col("source").isin("published", "charm"))
    item = ["run", "seed", "item_id"]
    keep = ["fold", "dataset", "y", "source", "method", "score", "pred"]
    g = p.groupBy(*item).agg(F.collect_list(F.struct(*keep)).alias("p"), F.bool_or(F.col("source") == "published").alias("base"), F.bool_or(F.col("source") == "charm").alias("second"))  # an item's few methods
    rows = g.filter("base and second").select(*item, F.explode("p").alias("p")).select(*item, "p.*")
    return rows.withColumn("score", out("score"))


@q("align_counts", sql=S.with_(V.SQL_PREDICTIONS, _ALIGNED) + "select run, seed, count(*) as n_base, count(*) filter (where second) as n_aligned, count(*) filter (where not second) as n_dropped from al group by all")
def align_counts(spark: SparkSession, d: str) -> DataFrame:
    """Items of the base set that the second source has too, and how many drop out, by run and seed."""
    rows = V.predictions(spark, d).groupBy("run", "seed", "item_id").agg(F.bool_or(F.col("source") == "published").alias("base"), F.bool_or(F.col("source") == "charm").alias("second")).filter("base")
    return rows.groupBy("run", "seed").agg(F.count(F.lit(1)).alias("n_base"), X.count_if(F.col("second")).alias("n_aligned"), X.count_if(~F.col("second")).alias("n_dropped"))


@q(
    "pair_seed_summary",
    sql=S.with_(
        V.SQL_PREDICTIONS, SQL_PAIRS, f"m as (select seed, ma as method_a, mb as method_b, {_DISCORD}, {_CELLS} from pr group by all)",
        f"v as (select method_a, method_b, b, c, {P.sql_mcnemar_p('b', 'c')} as p, {S.kappa('n11', 'n10', 'n01', 'n00')} as k, (n11 + n00) / cast(n11 + n10 + n01 + n00 as double) as agree from m)",
    )
    + "select method_a, method_b, count(*) as n_seeds, round(avg(k), 9) as kappa_mean, round(stddev_pop(k), 9) as kappa_std, round(avg(agree), 9) as agreement_mean, round(median(p), 6) as p_median, count(*) filter (where p < 0.05) as n_significant, round(avg(b), 9) as b_mean, round(avg(c), 9) as c_mean from v group by all",
)
def pair_seed_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of methods over seeds: kappa, agreement, median p, seeds with a significant difference, mean discordant counts."""
    b, c = (_right("a") & ~_right("b")), (~_right("a") & _right("b"))
    m = pair_rows(spark, d).groupBy("seed", F.col("a.method").alias("method_a"), F.col("b.method").alias("method_b")).agg(X.count_if(b).alias("b"), X.count_if(c).alias("c"), *_cells())
    agree = (F.col("n11") + F.col("n00")) / (F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")).cast("double")
    v = m.select("method_a", "method_b", "b", "c", P.mcnemar_p(F.col("b"), F.col("c")).alias("p"), X.kappa("n11", "n10", "n01", "n00").alias("k"), agree.alias("agree"))
    return v.groupBy("method_a", "method_b").agg(
        F.count(F.lit(1)).alias("n_seeds"), out(F.avg("k")).alias("kappa_mean"), out(F.stddev_pop("k")).alias("kappa_std"), out(F.avg("agree")).alias("agreement_mean"),
        F.round(F.percentile("p", F.lit(0.5)), 6).alias("p_median"), F.coalesce(X.count_if(F.col("p") < 0.05), F.lit(0)).alias("n_significant"), out(F.avg("b")).alias("b_mean"), out(F.avg("c")).alias("c_mean"),
    )


@q(
    "merge_with_assert",
    sql=S.with_(V.SQL_PREDICTIONS, "b as (select seed, item_id, max(y) as y from pred where source = 'published' group by all), c as (select seed, item_id, max(y) as y from pred where source = 'charm' group by all)", "m as (select c.seed, count(*) as n, count(*) filter (where b.item_id is null) as n_missing, count(*) filter (where b.y <> c.y) as n_mismatch from c left join b using (seed, item_id) group by all)")
    + "select seed, n, n_missing, n_mismatch, n_missing = 0 and n_mismatch = 0 as accepted from m",
)
def merge_with_assert(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of the second source that may be merged: no item missing, no label different."""
    p = V.predictions(spark, d)
    b = p.filter("source = 'published'").groupBy("seed", "item_id").agg(F.max("y").alias("yb"))
    c = p.filter("source = 'charm'").groupBy("seed", "item_id").agg(F.max("y").alias("yc"))
    m = c.join(b, ["seed", "item_id"], "left").groupBy("seed").agg(F.count(F.lit(1)).alias("n"), X.count_if(F.col("yb").isNull()).alias("n_missing"), F.coalesce(X.count_if(F.col("yb") != F.col("yc")), F.lit(0)).alias("n_mismatch"))
    return m.withColumn("accepted", (F.col("n_missing") == 0) & (F.col("n_mismatch") == 0))


@q(
    "verify_draw",
    sql=S.with_(V.SQL_PREDICTIONS, "a as (select seed, count(*) as n, avg(cast(y as double)) as rate from (select distinct seed, item_id, y from pred where method = 'saplma') group by all), b as (select seed, count(*) as n, avg(cast(y as double)) as rate from (select distinct seed, item_id, y from pred where method = 'lapeigvals') group by all)")
    + "select seed, a.n as n_a, b.n as n_b, round(a.rate, 9) as rate_a, round(b.rate, 9) as rate_b, a.n = b.n and abs(a.rate - b.rate) < 2e-3 as same_draw from a join b using (seed)",
)
def verify_draw(spark: SparkSession, d: str) -> DataFrame:
    """Whether two methods' runs used the same draw: equal sizes and positive rates within 0.002."""
    p = V.predictions(spark, d).select("seed", "item_id", "y", "method").distinct()
    one = lambda m, s: p.filter(F.col("method") == m).groupBy("seed").agg(F.count(F.lit(1)).alias(f"n_{s}"), F.avg(F.col("y").cast("double")).alias(f"r_{s}"))
    j = one("saplma", "a").join(one("lapeigvals", "b"), "seed")
    same = (F.col("n_a") == F.col("n_b")) & (F.abs(F.col("r_a") - F.col("r_b")) < 2e-3)
    return j.select("seed", "n_a", "n_b", out("r_a").alias("rate_a"), out("r_b").alias("rate_b"), same.alias("same_draw"))


@q("required_items", sql=S.with_(V.SQL_PREDICTIONS) + "select item_id, count(distinct seed) as n_draws from pred where pred is null or score is null or method = 'charm' group by all")
def required_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that some pending draw needs, with the number of draws: a union without copies."""
    p = V.predictions(spark, d)
    need = p.filter("pred is null or score is null").select("item_id", "seed").union(p.filter("method = 'charm'").select("item_id", "seed")).distinct()
    return need.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_draws"))


@q(
    "oracle_table",
    sql=S.with_(V.SQL_PREDICTIONS, S.scoped("pred"), f"c as (select scope, method, {S.confusion()} from sc where pred is not null group by all)", f"m as (select scope, method, {S.mcc()} as m from c)", "o as (select run, seed, fold, dataset, item_id, y, bool_or(pred = y) as any_right from pred where pred is not null and not starts_with(method, 'union') group by all)", "os as (select unnest(list_filter(['pooled', dataset, case when dataset <> 'coqa' then 'pooled_no_coqa' end], lambda x: x is not null)) as scope, y, case when any_right then y else 1 - y end as pred from o)", f"oc as (select scope, {S.confusion()} from os group by all)", f"om as (select scope, {S.mcc()} as oracle from oc)", "b as (select scope, max(m) filter (where not starts_with(method, 'union')) as best_single, arg_max(method, struct_pack(m := round(m, 12), n := method)) filter (where not starts_with(method, 'union')) as best_method, max(m) filter (where starts_with(method, 'union')) as best_ensemble from m group by all)")
    + "select scope, round(oracle, 9) as oracle, best_method, round(best_single, 9) as best_single, round(best_ensemble, 9) as best_ensemble, round(oracle - greatest(best_single, coalesce(best_ensemble, best_single)), 9) as unexploited from b join om using (scope)",
)
def oracle_table(spark: SparkSession, d: str) -> DataFrame:
    """Oracle, best single method, best ensemble and what stays unexploited, by scope."""
    p = decided(spark, d)
    m = R.scoped(p).groupBy("scope", "method").agg(*X.confusion()).select("scope", "method", X.mcc().alias("m"))
    single = ~F.col("method").startswith("union")
    b = m.groupBy("scope").agg(F.max(F.when(single, F.col("m"))).alias("best_single"), F.max_by(F.when(single, F.col("method")), F.when(single, F.struct(F.round("m", 12), "method"))).alias("best_method"), F.max(F.when(~single, F.col("m"))).alias("best_ensemble"))
    o = p.filter(single).groupBy(*ITEM).agg(F.bool_or(F.col("pred") == F.col("y")).alias("ok"))
    o = R.scoped(o.withColumn("pred", F.when(F.col("ok"), F.col("y")).otherwise(1 - F.col("y")))).groupBy("scope").agg(*X.confusion()).select("scope", X.mcc().alias("oracle"))
    best = F.greatest("best_single", F.coalesce("best_ensemble", "best_single"))
    return b.join(o, "scope").select("scope", out("oracle").alias("oracle"), "best_method", out("best_single").alias("best_single"), out("best_ensemble").alias("best_ensemble"), out(F.col("oracle") - best).alias("unexploited"))


@q(
    "fp_score_baseline",
    sql=S.with_(V.SQL_PREDICTIONS, "pos as (select method, score, y from pred where pred = 1 and score is not null)", S.auroc("pos", "method")) + "select method, n_pos, n_neg, round(auroc, 9) as auroc from roc",
)
def fp_score_baseline(spark: SparkSession, d: str) -> DataFrame:
    """How well the score alone tells true from false positives."""
    return R.auroc(V.predictions(spark, d).filter("pred = 1"), ["method"]).withColumn("auroc", out("auroc"))


@q(
    "referee_routable",
    sql=S.with_(V.SQL_PREDICTIONS, SQL_PAIRS, "x as (select ma as method_a, mb as method_b, pa = y as ra, pb = y as rb, abs(sa - 0.5e0) >= abs(sb - 0.5e0) as to_a, sa, sb from pr)")
    + """select method_a, method_b, count(*) as n, count(*) filter (where ra <> rb) as n_routable, count(*) filter (where ra and not rb) as a_right,
           round(avg(cast(case when to_a then ra else rb end as int)) filter (where ra <> rb and sa is not null and sb is not null), 9) as routed_accuracy from x group by all""",
)
def referee_routable(spark: SparkSession, d: str) -> DataFrame:
    """Items that exactly one of two methods gets right, and the accuracy of routing to the surer score."""
    r = pair_rows(spark, d, with_score=True)
    a, b = _right("a"), _right("b")
    to_a = F.abs(F.col("a.score") - 0.5) >= F.abs(F.col("b.score") - 0.5)
    routed = F.when((a != b) & F.col("a.score").isNotNull() & F.col("b.score").isNotNull(), F.when(to_a, a).otherwise(b).cast("int"))
    return r.groupBy(F.col("a.method").alias("method_a"), F.col("b.method").alias("method_b")).agg(F.count(F.lit(1)).alias("n"), X.count_if(a != b).alias("n_routable"), X.count_if(a & ~b).alias("a_right"), out(F.avg(routed)).alias("routed_accuracy"))


@q(
    "rescue_descriptive",
    sql=S.with_(V.SQL_PREDICTIONS, _ITEMS_RIGHT, "ans as (select item_id, max(answer_tokens) as tokens, max(len(gold_answers)) as n_gold from answers group by all)")
    + """select others_right > 0 as rescued, count(*) as n, round(avg(cast(y as double)), 9) as positive_rate, round(avg(cast(tokens as double)), 9) as mean_tokens,
           round(avg(cast(n_gold as double)), 9) as mean_golds from it left join ans using (item_id) where anchor_right = 0 group by all""",
)
def rescue_descriptive(spark: SparkSession, d: str) -> DataFrame:
    """The anchor's errors that others get right, beside those that none does."""
    r = items_right(spark, d).filter("anchor_right = 0").join(answers_by_item(spark, d), "item_id", "left")
    mean = lambda c: out(F.avg(F.col(c).cast("double")))
    return r.groupBy((F.col("others_right") > 0).alias("rescued")).agg(F.count(F.lit(1)).alias("n"), mean("y").alias("positive_rate"), mean("tokens").alias("mean_tokens"), mean("n_gold").alias("mean_golds"))


STRIDE = 7


@q(
    "pilot_consensus",
    sql=S.with_(
        V.SQL_VOTES,
        "o as (select item_id, row_number() over (order by item_id) - 1 as k from (select distinct item_id from votes))",
        "s as (select votes.* from votes join o using (item_id) where k % 7 = 0)",
        "c as (select item_id, label as candidate from s where judge = 'judge-brou-12b')",
        "r as (select item_id, min(label) as lo, max(label) as hi, count(*) as k from s where judge <> 'judge-brou-12b' group by all)",
        "j as (select c.candidate = 'HALLUCINATED' as ch, case when lo = hi and k >= 2 then lo end as consensus from c join r using (item_id))",
        "x as (select count(*) as n, avg(cast(ch as int)) as candidate_rate, count(consensus) as n_consensus, count(*) filter (where ch and consensus = 'HALLUCINATED') as n11, count(*) filter (where ch and consensus <> 'HALLUCINATED') as n10, count(*) filter (where not ch and consensus = 'HALLUCINATED') as n01, count(*) filter (where not ch and consensus <> 'HALLUCINATED') as n00 from j)",
    )
    + f"select n, n_consensus, round(candidate_rate, 9) as candidate_rate, round({S.kappa('n11', 'n10', 'n01', 'n00')}, 9) as kappa_consensus from x",
)
def pilot_consensus(spark: SparkSession, d: str) -> DataFrame:
    """A candidate judge on every seventh item against the consensus of the others (all equal, two at least)."""
    v = V.votes(spark, d)
    ids = v.select("item_id").distinct()
    placed = R.numbers(ids, [], "item_id").filter(F.col("k") % STRIDE == 0).select("item_id")
    mine = F.col("judge") == "judge-brou-12b"
    j = v.join(placed, "item_id").groupBy("item_id").agg(
        F.max(F.when(mine, F.col("label"))).alias("candidate"), F.min(F.when(~mine, F.col("label"))).alias("lo"), F.max(F.when(~mine, F.col("label"))).alias("hi"), X.count_if(~mine).alias("k")
    ).filter("candidate is not null and k > 0")
    j = j.select((F.col("candidate") == "HALLUCINATED").alias("ch"), F.when((F.col("lo") == F.col("hi")) & (F.col("k") >= 2), F.col("lo")).alias("consensus"))
    hall = F.col("consensus") == "HALLUCINATED"
    cells = {"n11": F.col("ch") & hall, "n10": F.col("ch") & ~hall, "n01": ~F.col("ch") & hall, "n00": ~F.col("ch") & ~hall}
    x = j.agg(F.count(F.lit(1)).alias("n"), F.count("consensus").alias("n_consensus"), F.avg(F.col("ch").cast("int")).alias("rate"), *[F.coalesce(X.count_if(c), F.lit(0)).alias(k) for k, c in cells.items()])
    return x.select("n", "n_consensus", out("rate").alias("candidate_rate"), out(X.kappa("n11", "n10", "n01", "n00")).alias("kappa_consensus"))


@q(
    "pilot_judges",
    sql=S.with_(
        V.SQL_VOTES,
        "o as (select item_id, row_number() over (order by item_id) - 1 as k from (select distinct item_id from votes))",
        "s as (select votes.* from votes join o using (item_id) where k % 7 = 0)",
        "j as (select r.judge, c.label = 'HALLUCINATED' as ch, r.label = 'HALLUCINATED' as jh from s c join s r on r.item_id = c.item_id and r.judge <> c.judge where c.judge = 'judge-brou-12b')",
        "x as (select judge, count(*) as n, count(*) filter (where ch and jh) as n11, count(*) filter (where ch and not jh) as n10, count(*) filter (where not ch and jh) as n01, count(*) filter (where not ch and not jh) as n00 from j group by all)",
    )
    + f"select judge, n, round((n11 + n10) / cast(n as double), 9) as candidate_rate, round((n11 + n01) / cast(n as double), 9) as judge_rate, round({S.kappa('n11', 'n10', 'n01', 'n00')}, 9) as kappa from x",
)
def pilot_judges(spark: SparkSession, d: str) -> DataFrame:
    """The candidate judge on every seventh item against each other judge."""
    v = V.votes(spark, d)
    placed = R.numbers(v.select("item_id").distinct(), [], "item_id").filter(F.col("k") % STRIDE == 0).select("item_id")
    hall = F.col("label") == "HALLUCINATED"
    g = v.join(placed, "item_id").groupBy("item_id").agg(F.max(F.when(F.col("judge") == "judge-brou-12b", hall)).alias("ch"), F.collect_list(F.struct("judge", hall.alias("jh"))).alias("j")).filter("ch is not null")
    j = g.select("ch", F.explode("j").alias("j")).select("ch", "j.*").filter("judge <> 'judge-brou-12b'")
    cells = {"n11": F.col("ch") & F.col("jh"), "n10": F.col("ch") & ~F.col("jh"), "n01": ~F.col("ch") & F.col("jh"), "n00": ~F.col("ch") & ~F.col("jh")}
    x = j.groupBy("judge").agg(F.count(F.lit(1)).alias("n"), *[X.count_if(c).alias(k) for k, c in cells.items()])
    n = F.col("n").cast("double")
    return x.select("judge", "n", out((F.col("n11") + F.col("n10")) / n).alias("candidate_rate"), out((F.col("n11") + F.col("n01")) / n).alias("judge_rate"), out(X.kappa("n11", "n10", "n01", "n00")).alias("kappa"))
