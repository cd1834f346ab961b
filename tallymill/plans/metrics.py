"""Quality of scores and decisions: counts, correlations, curves, thresholds, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.functions import expressions as X
from tallymill.functions import sqltext as S
from tallymill.functions.expressions import out
from tallymill.operators import ranked as R
from tallymill.registry import CORE
from tallymill.sources import views as V

q = CORE.query


@q("mcc_by_method", sql=S.with_(V.SQL_PREDICTIONS, S.scoped("pred"), f"c as (select scope, method, {S.confusion()} from sc group by all)") + f"select *, round({S.mcc()}, 9) as mcc from c")
def mcc_by_method(spark: SparkSession, d: str) -> DataFrame:
    """Counts and MCC of each method, pooled and by data set."""
    rows = R.scoped(V.predictions(spark, d)).groupBy("scope", "method").agg(*X.confusion())
    return rows.select("*", out(X.mcc()).alias("mcc"))


@q(
    "metrics_by_scope",
    sql=S.with_(V.SQL_BIG, S.scoped("big"), f"c as (select scope, method, {S.confusion()} from sc where scope <> 'pooled_no_coqa' group by all having min(y) <> max(y))")
    + f"select *, round({S.mcc()}, 9) as mcc, round({S.accuracy()}, 9) as accuracy from c",
)
def metrics_by_scope(spark: SparkSession, d: str) -> DataFrame:
    """Counts, MCC and accuracy over all line items; scopes with one class are left out."""
    rows = R.scoped(V.big(spark, d), no_coqa=False).groupBy("scope", "method").agg(*X.confusion(), R.two_classes().alias("two")).filter("two").drop("two")
    return rows.select("*", out(X.mcc()).alias("mcc"), out(X.accuracy()).alias("accuracy"))


@q(
    "score_predictions",
    sql=S.with_(
        V.SQL_PREDICTIONS,
        S.auroc("pred", "method"),
        f"c as (select method, {S.confusion()}, count(*) as n, avg(cast(y as double)) as rate, avg(threshold) as threshold from pred group by all)",
    )
    + f"""select c.method, c.n, round(rate, 9) as positive_rate, round(threshold, 9) as threshold, round(auroc, 9) as auroc,
          round({S.mcc()}, 9) as mcc, round({S.accuracy()}, 9) as accuracy, round({S.f1()}, 9) as f1
          from c left join roc using (method)""",
)
def score_predictions(spark: SparkSession, d: str) -> DataFrame:
    """AUROC, MCC, accuracy, F1, threshold, size and positive rate of each method."""
    p = V.predictions(spark, d)
    c = p.groupBy("method").agg(*X.confusion(), F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("rate"), F.avg("threshold").alias("threshold"))
    r = c.join(R.auroc(p, ["method"]), "method", "left")
    return r.select("method", "n", out("rate").alias("positive_rate"), out("threshold").alias("threshold"), out("auroc").alias("auroc"), out(X.mcc()).alias("mcc"), out(X.accuracy()).alias("accuracy"), out(X.f1()).alias("f1"))


@q(
    "full_metrics",
    sql=S.with_(V.SQL_PREDICTIONS, S.scoped("pred"), f"c as (select scope, method, {S.confusion()}, avg(cast(y as double)) as rate, count(*) as n from sc group by all having min(y) <> max(y))")
    + f"""select scope, method, n, round({S.accuracy()}, 9) as accuracy, round({S.balanced()}, 9) as balanced_accuracy, round({S.precision()}, 9) as prec,
          round({S.recall()}, 9) as rec, round({S.f1()}, 9) as f1, round({S.mcc()}, 9) as mcc, round(greatest(rate, 1 - rate), 9) as majority_accuracy from c""",
)
def full_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All decision metrics of each method in each scope with two classes."""
    c = R.scoped(V.predictions(spark, d)).groupBy("scope", "method")
    c = c.agg(*X.confusion(), F.avg(F.col("y").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"), R.two_classes().alias("two")).filter("two")
    return c.select(
        "scope", "method", "n", out(X.accuracy()).alias("accuracy"), out(X.balanced_accuracy()).alias("balanced_accuracy"), out(X.precision()).alias("prec"),
        out(X.recall()).alias("rec"), out(X.f1()).alias("f1"), out(X.mcc()).alias("mcc"), out(F.greatest(F.col("rate"), 1 - F.col("rate"))).alias("majority_accuracy"),
    )


@q("auroc_by_scope", sql=S.with_(V.SQL_BIG, S.scoped("big"), S.auroc("sc", "scope, method")) + "select scope, method, n_pos, n_neg, round(auroc, 9) as auroc from roc")
def auroc_by_scope(spark: SparkSession, d: str) -> DataFrame:
    """AUROC over all line items, ties averaged; distinct scores are counted by data set and added up by scope."""
    return R.auroc(V.big(spark, d), ["scope", "method"]).withColumn("auroc", out("auroc"))


@q(
    "seed_summary",
    sql=S.with_(V.SQL_PREDICTIONS, f"c as (select seed, method, {S.confusion()} from pred group by all)", f"m as (select seed, method, {S.mcc()} as mcc from c)")
    + "select method, count(*) as n_seeds, round(avg(mcc), 9) as mcc_mean, round(stddev_pop(mcc), 9) as mcc_std, round(median(mcc), 9) as mcc_median, round(min(mcc), 9) as mcc_min, round(max(mcc), 9) as mcc_max from m group by all",
)
def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean, population deviation and median of the MCC over seeds."""
    m = V.predictions(spark, d).groupBy("seed", "method").agg(*X.confusion()).select("method", X.mcc().alias("mcc"))
    return m.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_seeds"), out(F.avg("mcc")).alias("mcc_mean"), out(F.stddev_pop("mcc")).alias("mcc_std"),
        out(F.percentile("mcc", F.lit(0.5))).alias("mcc_median"), out(F.min("mcc")).alias("mcc_min"), out(F.max("mcc")).alias("mcc_max"),
    )


@q(
    "rank_scale",
    sql=S.with_(V.SQL_PREDICTIONS, "p as (select * from pred where score is not null)")
    + """select seed, method, item_id, round((rank() over w + (count(*) over (partition by seed, method, score) - 1) / 2e0) / count(*) over (partition by seed, method), 9) as scaled
         from p window w as (partition by seed, method order by score)""",
)
def rank_scale(spark: SparkSession, d: str) -> DataFrame:
    """Average ranks within seed and method, as shares of the rows."""
    p = V.predictions(spark, d).filter("score is not null")
    by = ["seed", "method"]
    n = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    ranks = R.average_ranks(p, by).join(n, by)
    return p.join(ranks, [*by, "score"]).select("seed", "method", "item_id", out(F.col("avg_rank") / F.col("n")).alias("scaled"))


@q("best_threshold", sql=S.with_(V.SQL_PREDICTIONS, S.threshold("pred", "method")) + "select method, round(threshold, 9) as threshold, round(mcc, 9) as mcc from thr")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The threshold between neighbouring scores with the highest MCC; the lowest of equals."""
    t = R.best_threshold(V.predictions(spark, d), ["method"])
    return t.select("method", out("threshold").alias("threshold"), out("mcc").alias("mcc"))


@q("best_threshold_big", sql=S.with_(V.SQL_BIG, S.threshold("big", "dataset, method")) + "select dataset, method, round(threshold, 9) as threshold, round(mcc, 9) as mcc from thr")
def best_threshold_big(spark: SparkSession, d: str) -> DataFrame:
    """The same over all line items, by line status."""
    t = R.best_threshold(V.big(spark, d), ["dataset", "method"])
    return t.select("dataset", "method", out("threshold").alias("threshold"), out("mcc").alias("mcc"))


_GRID = [round(0.05 + 0.01 * k, 2) for k in range(91)]


def held_out_threshold(p: DataFrame, by: list[str], grid: list[float] = _GRID) -> DataFrame:
    """(by…, fold, threshold): for each fold, the quantile of the other folds' scores with their best MCC.

    Equal MCCs go to the first grid point.
    """
    rows = p.filter("score is not null and y is not null")
    g = R.held_out_grid(rows, by, "score", {"pos": F.col("y")}, grid)
    fn, tn = F.col("below_pos"), F.col("n_below") - F.col("below_pos")
    g = g.select(*by, "held", "k", "t", fn.alias("fn"), tn.alias("tn"), (F.col("total_pos") - fn).alias("tp"), (F.col("n") - F.col("total_pos") - tn).alias("fp"))
    best = F.max_by("t", F.struct(F.round(X.mcc(), 12), -F.col("k")))
    return g.groupBy(*by, F.col("held").alias("fold")).agg(best.alias("threshold"))


def sql_held_out(source: str, by: str, name: str = "ho") -> str:
    """CTEs that end in ``name``(by…, fold, threshold)."""
    k = ", ".join(f"a.{c.strip()}" for c in by.split(","))
    grid = ", ".join(f"{g}e0" for g in _GRID)
    return f"""
{name}_s as (select {by}, fold, score, y from {source} where score is not null),
{name}_f as (select distinct {by}, fold as held from {name}_s),
{name}_t as (select {k}, a.held, b.score, b.y from {name}_f a join {name}_s b using ({by}) where b.fold <> a.held),
{name}_q as (select {by}, held, unnest(quantile_cont(score, [{grid}])) as t, unnest(range({len(_GRID)})) as k from {name}_t group by {by}, held),
{name}_c as (select {k}, a.held, b.k, b.t, count(*) filter (where y = 1 and score >= t) as tp, count(*) filter (where y = 0 and score >= t) as fp,
              count(*) filter (where y = 1 and score < t) as fn, count(*) filter (where y = 0 and score < t) as tn
            from {name}_t a join {name}_q b using ({by}, held) group by all),
{name} as (select {by}, held as fold, arg_max(t, struct_pack(m := round({S.mcc()}, 12), k := -k)) as threshold from {name}_c group by all)"""


@q(
    "crossfit_threshold",
    sql=S.with_(V.SQL_PREDICTIONS, sql_held_out("pred", "method"), f"c as (select p.method, {S.confusion('y', 'cast(score >= t.threshold as int)')} from pred p join ho t using (method, fold) where score is not null group by all)")
    + f"select *, round({S.mcc()}, 9) as mcc from c",
)
def crossfit_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by thresholds chosen on the other folds, and their MCC."""
    p = V.predictions(spark, d).filter("score is not null")
    t = held_out_threshold(p, ["method"]).withColumnRenamed("threshold", "t")
    rows = p.join(t, ["method", "fold"]).withColumn("pred", (F.col("score") >= F.col("t")).cast("int"))
    c = rows.groupBy("method").agg(*X.confusion())
    return c.select("*", out(X.mcc()).alias("mcc"))


_COVERAGES = (0.5, 0.7, 0.8, 0.9, 1.0)


@q(
    "risk_coverage",
    sql=S.with_(V.SQL_PREDICTIONS, "p as (select *, row_number() over (partition by seed, method order by score, item_id) as r, count(*) over (partition by seed, method) as n from pred where score is not null)", "g as (select unnest([0.5e0, 0.7e0, 0.8e0, 0.9e0, 1.0e0]) as coverage)")
    + "select seed, method, coverage, cast(count(*) as bigint) as n_kept, round(avg(cast(y as double)), 9) as risk from p join g on r <= greatest(1, round_even(coverage * n, 0)) group by all",
)
def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of positives among the rows kept at each coverage, lowest scores first."""
    k = R.kept_at(V.predictions(spark, d).filter("score is not null"), ["seed", "method"], "score", "item_id", "y", list(_COVERAGES))
    return k.select("seed", "method", F.get(F.array(*[F.lit(c) for c in _COVERAGES]), F.col("g")).alias("coverage"), F.col("m").alias("n_kept"), out(F.col("pos") / F.col("m").cast("double")).alias("risk"))


@q(
    "precision_at",
    sql=S.with_(V.SQL_PREDICTIONS, "p as (select *, row_number() over (partition by seed, method order by score desc, item_id) as r, count(*) over (partition by seed, method) as n from pred where score is not null)", "g as (select unnest([0.05e0, 0.1e0, 0.2e0]) as flag_rate)")
    + "select seed, method, flag_rate, cast(count(*) as bigint) as n_flagged, round(avg(cast(y as double)), 9) as prec from p join g on r <= greatest(1, round_even(flag_rate * n, 0)) group by all",
)
def precision_at(spark: SparkSession, d: str) -> DataFrame:
    """Precision among the highest scores at each flag rate."""
    rates = [0.05, 0.1, 0.2]
    k = R.kept_at(V.predictions(spark, d).filter("score is not null"), ["seed", "method"], "score", "item_id", "y", rates, largest=True)
    return k.select("seed", "method", F.get(F.array(*[F.lit(c) for c in rates]), F.col("g")).alias("flag_rate"), F.col("m").alias("n_flagged"), out(F.col("pos") / F.col("m").cast("double")).alias("prec"))


@q(
    "aurc",
    sql=S.with_(
        V.SQL_PREDICTIONS,
        "p as (select seed, method, y, row_number() over (partition by seed, method order by score, item_id) as r, count(*) over (partition by seed, method) as n from pred where score is not null)",
        "c as (select *, avg(cast(y as double)) over (partition by seed, method order by r rows between unbounded preceding and current row) as risk from p)",
        "g as (select distinct seed, method, n, k, greatest(1, cast(round_even((0.05e0 + 0.95e0 * k / 39e0) * n, 0) as bigint)) as at from p, (select unnest(range(40)) as k))",
    )
    + "select g.seed, g.method, round(avg(risk), 9) as aurc from g join c on c.seed = g.seed and c.method = g.method and c.r = g.at group by all",
)
def aurc(spark: SparkSession, d: str) -> DataFrame:
    """Mean risk over forty coverages from 0.05 to 1."""
    k = R.kept_at(V.predictions(spark, d).filter("score is not null"), ["seed", "method"], "score", "item_id", "y", [0.05 + 0.95 * k / 39.0 for k in range(40)])
    return k.groupBy("seed", "method").agg(out(F.avg(F.col("pos") / F.col("m").cast("double"))).alias("aurc"))


@q(
    "confidence_deciles",
    sql=S.with_(
        V.SQL_PREDICTIONS,
        "p as (select method, y, pred, round(abs(score - threshold), 9) as x from pred where score is not null and pred is not null)",
        "e as (select method, quantile_cont(x, [0e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0, 1e0]) as e from p group by all)",
        "b as (select p.*, least(9, len(list_filter(e.e, lambda t: round(t, 9) <= x)) - 1) as decile from p join e using (method))",
    )
    + "select method, cast(decile as bigint) as decile, count(*) as n, round(avg(cast(y = pred as int)), 9) as accuracy, round(min(x), 9) as low, round(max(x), 9) as high from b group by all",
)
def confidence_deciles(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by decile of the distance from the threshold; equal edges are allowed."""
    p = V.predictions(spark, d).filter("score is not null and pred is not null").select("method", "y", "pred", F.round(F.abs(F.col("score") - F.col("threshold")), 9).alias("x"))
    e = R.percentiles(p, ["method"], "x", [k / 10 for k in range(11)]).withColumnRenamed("cuts", "e")
    b = p.join(e, "method").withColumn("decile", F.least(F.lit(9), F.size(F.filter("e", lambda t: F.round(t, 9) <= F.col("x"))) - 1).cast("long"))
    return b.groupBy("method", "decile").agg(F.count(F.lit(1)).alias("n"), out(F.avg((F.col("y") == F.col("pred")).cast("int"))).alias("accuracy"), out(F.min("x")).alias("low"), out(F.max("x")).alias("high"))


_BINS = "c as (select {k}, least(greatest(score, 0e0), 1e0) as s, y from pred where score is not null), b as (select *, least(cast(floor(s * 10) as bigint), 9) as bin from c)"


@q(
    "reliability_curve",
    sql=S.with_(V.SQL_PREDICTIONS, _BINS.format(k="seed, method"))
    + "select method, bin, count(*) as n, round(avg(s), 9) as confidence, round(avg(cast(y as double)), 9) as observed from b where seed = (select min(seed) from b) group by all",
)
def reliability_curve(spark: SparkSession, d: str) -> DataFrame:
    """Mean score and share of positives by tenth of the score, of the first seed; empty bins are left out."""
    p = V.predictions(spark, d).filter("score is not null")
    first = p.agg(F.min("seed")).first()[0]
    return _bins(p.filter(F.col("seed") == F.lit(first))).groupBy("method", "bin").agg(F.count(F.lit(1)).alias("n"), out(F.avg("s")).alias("confidence"), out(F.avg(F.col("y").cast("double"))).alias("observed"))


def _bins(p: DataFrame) -> DataFrame:
    s = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return p.withColumn("s", s).withColumn("bin", F.least(F.floor(F.col("s") * 10), F.lit(9)).cast("long"))


@q(
    "calibration",
    sql=S.with_(
        V.SQL_PREDICTIONS,
        _BINS.format(k="method"),
        "e as (select method, bin, count(*) as n, abs(avg(s) - avg(cast(y as double))) as gap from b group by all)",
        "f as (select method, sum(n * gap) / sum(n) as ece from e group by all)",
        "g as (select method, avg(power(s - y, 2)) as brier, count(*) as n from c group by all)",
    )
    + "select method, n, round(brier, 9) as brier, round(ece, 9) as ece from f join g using (method)",
)
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Brier score and expected calibration error over ten bins, scores clipped to 0 … 1."""
    b = _bins(V.predictions(spark, d).filter("score is not null"))
    per = b.groupBy("method", "bin").agg(F.count(F.lit(1)).alias("k"), F.abs(F.avg("s") - F.avg(F.col("y").cast("double"))).alias("gap"), F.sum((F.col("s") - F.col("y")) * (F.col("s") - F.col("y"))).alias("sq"))
    return per.groupBy("method").agg(F.sum("k").alias("n"), out(F.sum("sq") / F.sum("k")).alias("brier"), out(F.sum(F.col("k") * F.col("gap")) / F.sum("k")).alias("ece"))


_ANSWERS = """
ans as (select item_id, max(answer_tokens) as tokens, max(len(gold_answers)) as n_gold, bool_and(has_context) as has_context from answers group by all)"""


def answers_by_item(spark: SparkSession, d: str) -> DataFrame:
    from tallymill.sources.tables import table

    return table(spark, d, "answers").groupBy("item_id").agg(F.max("answer_tokens").alias("tokens"), F.max(F.size("gold_answers")).alias("n_gold"), F.bool_and("has_context").alias("has_context"))


@q(
    "length_quartile_mcc",
    sql=S.with_(
        V.SQL_PREDICTIONS, _ANSWERS,
        "p as (select method, y, pred, tokens from pred join ans using (item_id) where tokens is not null)",
        "e as (select quantile_cont(tokens, [0.25e0, 0.5e0, 0.75e0]) as e from (select distinct item_id, tokens from ans where tokens is not null and item_id in (select item_id from pred)))",
        "b as (select p.*, len(list_filter(e.e, lambda t: t <= tokens)) as quartile from p, e)",
        f"c as (select method, quartile, {S.confusion()}, count(*) as n from b group by all having count(*) > 20 and min(y) <> max(y))",
    )
    + f"select method, cast(quartile as bigint) as quartile, n, round({S.mcc()}, 9) as mcc from c",
)
def length_quartile_mcc(spark: SparkSession, d: str) -> DataFrame:
    """MCC by quartile of the answer's length; a value on an edge is in the upper bin; over 20 rows and both labels each."""
    p = V.predictions(spark, d).join(answers_by_item(spark, d).filter("tokens is not null"), "item_id")
    edges = R.percentiles(p.select("item_id", "tokens").distinct().withColumn("one", F.lit(1)), ["one"], "tokens", [0.25, 0.5, 0.75]).select(F.col("cuts").alias("e"))
    b = p.join(F.broadcast(edges)).withColumn("quartile", F.size(F.filter("e", lambda t: t <= F.col("tokens"))).cast("long"))  # one row of three edges
    c = b.groupBy("method", "quartile").agg(*X.confusion(), F.count(F.lit(1)).alias("n"), R.two_classes().alias("two")).filter("n > 20 and two")
    return c.select("method", "quartile", "n", out(X.mcc()).alias("mcc"))


@q(
    "spearman_len",
    sql=S.with_(
        V.SQL_PREDICTIONS, _ANSWERS,
        "p as (select method, score, cast(y as double) as y, cast(tokens as double) as tokens from pred join ans using (item_id) where tokens is not null and score is not null)",
        "r as (select method, rank() over (partition by method order by score) + (count(*) over (partition by method, score) - 1) / 2e0 as rs, rank() over (partition by method order by y) + (count(*) over (partition by method, y) - 1) / 2e0 as ry, rank() over (partition by method order by tokens) + (count(*) over (partition by method, tokens) - 1) / 2e0 as rt from p)",
    )
    + "select method, count(*) as n, round(corr(rs, rt), 9) as score_length, round(corr(ry, rt), 9) as label_length from r group by all",
)
def spearman_len(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlations of score and label with the answer's length."""
    p = V.predictions(spark, d).filter("score is not null").join(answers_by_item(spark, d).filter("tokens is not null"), "item_id")
    p = p.select("method", "score", F.col("y").cast("double").alias("y"), F.col("tokens").cast("double").alias("tokens"))
    for c, r in (("score", "rs"), ("y", "ry"), ("tokens", "rt")):
        p = p.join(R.average_ranks(p, ["method"], c).select("method", c, F.col("avg_rank").alias(r)), ["method", c])
    return p.groupBy("method").agg(F.count(F.lit(1)).alias("n"), out(F.corr("rs", "rt")).alias("score_length"), out(F.corr("ry", "rt")).alias("label_length"))


@q(
    "error_strata",
    sql=S.with_(
        V.SQL_PREDICTIONS, V.SQL_VOTES, _ANSWERS,
        "u as (select item_id, count(distinct label) = 1 as unanimous from votes group by all)",
        "p as (select method, y, pred, dataset, case when u.unanimous is null then 'unknown' when u.unanimous then 'unanimous' else 'split' end as agreement, case when n_gold is null then 'unknown' when n_gold <= 1 then '1' when n_gold <= 5 then '2-5' else '6+' end as golds from pred left join u using (item_id) left join ans using (item_id) where pred is not null)",
        "s as (select method, y, pred, unnest([{'stratum': 'dataset', 'value': dataset}, {'stratum': 'agreement', 'value': agreement}, {'stratum': 'golds', 'value': golds}], recursive := true) from p)",
        f"c as (select method, stratum, value, count(*) as n, avg(cast(y as double)) as rate, {S.confusion()} from s group by all having count(*) >= 30 and min(y) <> max(y))",
    )
    + f"select method, stratum, value, n, round(rate, 9) as positive_rate, round(1 - {S.accuracy()}, 9) as error_rate, round({S.mcc()}, 9) as mcc from c",
)
def error_strata(spark: SparkSession, d: str) -> DataFrame:
    """Errors and MCC by data set, by the judges' agreement and by the number of reference answers; 30 rows and both labels at least."""
    u = V.votes(spark, d).groupBy("item_id").agg((F.min("label") == F.max("label")).alias("unanimous"))
    p = V.predictions(spark, d).filter("pred is not null").join(u, "item_id", "left").join(answers_by_item(spark, d), "item_id", "left")
    agreement = F.when(F.col("unanimous").isNull(), "unknown").when(F.col("unanimous"), "unanimous").otherwise("split")
    golds = F.when(F.col("n_gold").isNull(), "unknown").when(F.col("n_gold") <= 1, "1").when(F.col("n_gold") <= 5, "2-5").otherwise("6+")
    s = p.select("method", "y", "pred", F.col("dataset").alias("dataset"), agreement.alias("agreement"), golds.alias("golds")).unpivot(["method", "y", "pred"], ["dataset", "agreement", "golds"], "stratum", "value")
    c = s.groupBy("method", "stratum", "value").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("rate"), R.two_classes().alias("two"), *X.confusion()).filter("n >= 30 and two")
    return c.select("method", "stratum", "value", "n", out("rate").alias("positive_rate"), out(1 - X.accuracy()).alias("error_rate"), out(X.mcc()).alias("mcc"))


_SIZES, _FRACTIONS = (20, 40, 80, 120, 200, 320, 500), (0.95, 0.99)


@q(
    "learning_crossing",
    sql=S.with_(
        V.SQL_LONG, "h as (select *, row_number() over (partition by method order by md5(concat_ws(':', 'curve', item_id)), item_id) as r from emb)",
        f"s as (select method, size, y, pred from h, (select unnest([{', '.join(map(str, _SIZES))}]) as size) where r <= size union all select method, null, y, pred from h)",
        f"c as (select method, size, {S.confusion()} from s group by all)", f"m as (select method, size, {S.mcc()} as v from c)",
        "f as (select m.*, e.v as final, unnest([0.95e0, 0.99e0]) as fraction from m join m e on e.method = m.method and e.size is null where m.size is not null)",
        "l as (select *, lag(size) over w as size0, lag(v) over w as v0, fraction * final as goal from f window w as (partition by method, fraction order by size))",
        "x as (select *, row_number() over (partition by method, fraction order by size) as k from l where v >= goal)",
        "a as (select distinct method, fraction, final from f)",
    )
    + "select a.method, a.fraction, round(a.final, 9) as final_mcc, round(case when v0 is null or v = v0 then size else size0 + (goal - v0) / (v - v0) * (size - size0) end, 6) as crossing from a left join x on x.method = a.method and x.fraction = a.fraction and k = 1",
)
def learning_crossing(spark: SparkSession, d: str) -> DataFrame:
    """Sizes at which the curve first reaches 95 and 99 % of its value on all rows, between two sizes by a straight line.

    Null where no size of the grid reaches it. Only the first rows in hash order are numbered.
    """
    p = V.long(V.wide(spark, d))
    h = X.order_hash(F.lit("curve"), F.col("item_id").cast("string"))
    first = p.withColumn("r", F.row_number().over(Window.partitionBy("method").orderBy(h, "item_id"))).filter(F.col("r") <= max(_SIZES))  # a limit per group: pruned before the shuffle
    s = first.withColumn("size", F.explode(F.array(*[F.lit(k) for k in _SIZES]))).filter("r <= size")
    m = s.groupBy("method", "size").agg(*X.confusion()).select("method", "size", X.mcc().alias("v"))
    final = p.groupBy("method").agg(*X.confusion()).select("method", X.mcc().alias("final")).withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in _FRACTIONS])))
    w = Window.partitionBy("method", "fraction").orderBy("size")  # a row per size
    m = m.join(final, "method").withColumn("size0", F.lag("size").over(w)).withColumn("v0", F.lag("v").over(w)).withColumn("goal", F.col("fraction") * F.col("final"))
    met = m.filter("v >= goal").groupBy("method", "fraction").agg(F.min_by(F.struct("size", "v", "size0", "v0", "goal"), "size").alias("f")).select("method", "fraction", "f.*")
    line = F.col("size0") + (F.col("goal") - F.col("v0")) / F.nullif(F.col("v") - F.col("v0"), F.lit(0.0)) * (F.col("size") - F.col("size0"))
    at = F.when(F.col("v0").isNull() | (F.col("v") == F.col("v0")), F.col("size").cast("double")).otherwise(line)
    return final.join(met, ["method", "fraction"], "left").select("method", "fraction", out("final").alias("final_mcc"), F.round(at, 6).alias("crossing"))


@q(
    "cumulative_mass",
    sql=S.with_(V.SQL_LONG, "u as (select method, abs(corr(score, cast(y as double))) * stddev_pop(score) as w from emb group by all)", "c as (select *, sum(w) over (order by w desc, method rows unbounded preceding) / sum(w) over () as cum, row_number() over (order by w desc, method) as k from u)")
    + "select method, cast(k as bigint) as k, round(w, 9) as weight, round(cum, 9) as mass, cast((select min(k) from c where cum >= 0.8e0 - 1e-12) as bigint) as n_for_80 from c",
)
def cumulative_mass(spark: SparkSession, d: str) -> DataFrame:
    """Columns by importance, their running share, and how many reach four fifths."""
    u = V.long(V.wide(spark, d)).groupBy("method").agg((F.abs(F.corr("score", F.col("y").cast("double"))) * F.stddev_pop("score")).alias("w"))
    one = Window.partitionBy(F.lit(1))  # over one row per column
    order = one.orderBy(F.desc("w"), "method")
    c = u.withColumn("cum", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(one)).withColumn("k", F.row_number().over(order).cast("long"))
    return c.select("method", "k", out("w").alias("weight"), out("cum").alias("mass"), F.min(F.when(F.col("cum") >= 0.8 - 1e-12, F.col("k"))).over(one).alias("n_for_80"))
