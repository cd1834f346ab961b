"""Array features of forward traces, attention graphs and message passing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.functions import expressions as X
from tallymill.functions import sqltext as S
from tallymill.functions.expressions import out
from tallymill.operators import ranked as R
from tallymill.registry import CORE
from tallymill.sources import views as V
from tallymill.sources.tables import table

q = CORE.query

# A block of four layers of sixteen values, from the embedding table.
_BLOCK = "bl as (select vec_id as item_id, label, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings)"


def block(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "label", X.doubles("embedding").alias("x"))


def layers(c: str = "x", n: int = 4, width: int = 16) -> F.Column:
    return F.array(*[F.slice(c, 1 + width * k, width) for k in range(n)])


@q("layer_slice", sql=S.with_(_BLOCK, "s as (select item_id, unnest([0, 2, 9]) as layer, [x[1:16], x[17:32], x[33:48], x[49:64]] as b from bl)") + "select item_id, cast(layer as int) as layer, list_transform(b[least(layer, 3) + 1], lambda v: round(v, 6)) as x from s")
def layer_slice(spark: SparkSession, d: str) -> DataFrame:
    """One layer of a block; a layer beyond the last is the last."""
    s = block(spark, d).select("item_id", F.explode(F.array(F.lit(0), F.lit(2), F.lit(9))).alias("layer"), layers().alias("b"))
    one = F.element_at("b", F.least(F.col("layer"), F.size("b") - 1) + 1)
    return s.select("item_id", "layer", F.transform(one, lambda v: F.round(v, 6)).alias("x"))


@q("flatten_block", sql=S.with_(_BLOCK, "s as (select item_id, flatten([x[1:16], x[17:32], x[33:48], x[49:64]]) as f from bl)") + "select item_id, len(f) as width, list_transform(f, lambda v: round(v, 6)) as x from s")
def flatten_block(spark: SparkSession, d: str) -> DataFrame:
    """A block of layers as one row of columns."""
    s = block(spark, d).select("item_id", F.flatten(layers()).alias("f"))
    return s.select("item_id", F.size("f").cast("long").alias("width"), F.transform("f", lambda v: F.round(v, 6)).alias("x"))


@q("depth_layers", sql="with n as (select unnest([12, 25, 33, 40]) as n) select cast(n as int) as n_layers, list_sort(list_distinct(list_transform([0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0, 1.0e0], lambda f: greatest(1, least(n, cast(round_even(f * n, 0) as int)))))) as layers from n")
def depth_layers(spark: SparkSession, d: str) -> DataFrame:
    """Fractions of the depth as distinct layer numbers, halves to even."""
    n = spark.createDataFrame([(k,) for k in (12, 25, 33, 40)], "n_layers int")
    fr = F.array(*[F.lit(f) for f in (0.1, 0.25, 0.5, 0.75, 0.9, 1.0)])
    return n.select("n_layers", F.array_sort(F.array_distinct(F.transform(fr, lambda f: F.greatest(F.lit(1), F.least(F.col("n_layers"), F.bround(f * F.col("n_layers"), 0).cast("int")))))).alias("layers"))


# The axes of the graph model's full grid.
GRID = {"hidden": (64, 128), "depth": (2, 3), "dropout": (0.1, 0.3), "rate": (3e-4, 1e-3, 3e-3), "decay": (0.0, 1e-4, 1e-2), "schedule": ("cosine", "plateau"), "weighting": ("none", "balanced"), "pooling": ("mean", "last")}


def _axis(v: tuple) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(float(x)) + "e0" if isinstance(x, float) and "e" not in repr(x) else repr(x) for x in v) + "]"


@q("param_grid", sql="select " + ", ".join(k for k in GRID) + " from " + ", ".join(f"(select unnest({_axis(v)}) as {k})" for k, v in GRID.items()))
def param_grid(spark: SparkSession, d: str) -> DataFrame:
    """All 576 points of the full grid, from its axes."""
    df = spark.range(1)
    for k, v in GRID.items():
        df = df.withColumn(k, F.explode(F.array(*[F.lit(x) for x in v])))
    return df.drop("id")


def top_k(c: F.Column | str, k: int) -> F.Column:
    """The k largest values, largest first, filled up with zeros."""
    top = F.slice(F.sort_array(c, asc=False), 1, k)
    return F.concat(top, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(k) - F.size(top))))


@q("topk_padded", sql=S.with_(_BLOCK, "s as (select item_id, list_reverse_sort(x[1:8])[1:12] as t from bl)") + "select item_id, list_transform(list_concat(t, list_transform(range(12 - len(t)), lambda k: 0e0)), lambda v: round(v, 6)) as top from s")
def topk_padded(spark: SparkSession, d: str) -> DataFrame:
    """The twelve largest of eight values: padded with zeros."""
    return block(spark, d).select("item_id", F.transform(top_k(F.slice("x", 1, 8), 12), lambda v: F.round(v, 6)).alias("top"))


@q("topk_prefix", sql=S.with_(_BLOCK, "s as (select item_id, list_concat(list_reverse_sort(x), list_transform(range(256 - len(x)), lambda k: 0e0)) as t from bl)") + "select item_id, list_transform(t[1:256], lambda v: round(v, 6)) as top256, list_transform(t[1:64], lambda v: round(v, 6)) as top64, list_transform(t[1:10], lambda v: round(v, 6)) as top10 from s")
def topk_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The 256 largest values, filled up with zeros; the 64 and the ten largest are their beginnings and are not sorted again."""
    t = F.transform(top_k("x", 256), lambda v: F.round(v, 6))
    return block(spark, d).select("item_id", t.alias("top256")).select("item_id", "top256", F.slice("top256", 1, 64).alias("top64"), F.slice("top256", 1, 10).alias("top10"))


_COLS = "co as (select item_id, label, unnest(range(64)) as dim, unnest(x) as v from bl)"


def columns(spark: SparkSession, d: str) -> DataFrame:
    return block(spark, d).select("item_id", "label", F.posexplode("x").alias("dim", "v"))


@q(
    "drop_degenerate",
    sql=S.with_(_BLOCK, _COLS, "w as (select dim, case when dim % 16 = 5 then 0e0 else v end as v from co)", "s as (select dim, var_pop(v) as var from w group by all)", "m as (select median(var) as m from s where var > 0)") + "select cast(dim as int) as dim, round(var, 9) as variance from s, m where var > greatest(1e-12, 1e-8 * m)",
)
def drop_degenerate(spark: SparkSession, d: str) -> DataFrame:
    """Columns that vary: beyond a small share of the median positive variance."""
    w = columns(spark, d).select("dim", F.when(F.col("dim") % 16 == 5, 0.0).otherwise(F.col("v")).alias("v"))
    s = w.groupBy("dim").agg(F.var_pop("v").alias("var"))
    m = s.filter("var > 0").agg(F.percentile("var", F.lit(0.5)).alias("m"))
    return s.join(F.broadcast(m)).filter(F.col("var") > F.greatest(F.lit(1e-12), F.lit(1e-8) * F.col("m"))).select("dim", out("var").alias("variance"))  # one row


@q(
    "median_impute",
    sql=S.with_(V.SQL_PREDICTIONS, "m as (select dataset, method, median(score) as m from pred group by all)") + "select item_id, seed, p.method, p.score is null as imputed, round(coalesce(score, m), 9) as score from pred p join m on m.dataset = p.dataset and m.method = p.method",
)
def median_impute(spark: SparkSession, d: str) -> DataFrame:
    """Missing scores become the median of their data set and method."""
    p = V.predictions(spark, d)
    m = R.percentiles(p, ["dataset", "method"], "score", [0.5]).select("dataset", "method", F.col("cuts")[0].alias("m"))
    m = p.select("dataset", "method").distinct().join(m, ["dataset", "method"], "left")
    return p.join(m, ["dataset", "method"]).select("item_id", "seed", "method", F.col("score").isNull().alias("imputed"), out(F.coalesce("score", "m")).alias("score"))


@q(
    "standardize",
    sql=S.with_(_BLOCK, _COLS, "s as (select dim, avg(v) as m, stddev_pop(v) as sd from co group by all)") + "select item_id, cast(co.dim as int) as dim, round((v - m) / case when sd = 0 then 1 else sd end, 6) as z from co join s using (dim)",
)
def standardize(spark: SparkSession, d: str) -> DataFrame:
    """Zero mean and unit population deviation of every column; constant columns are divided by 1."""
    c = columns(spark, d)
    s = c.groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    z = (F.col("v") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return c.join(F.broadcast(s), "dim").select("item_id", "dim", F.round(z, 6).alias("z"))  # a row per column


@q(
    "pls_first_component",
    sql=S.with_(_BLOCK, _COLS, "s as (select dim, avg(v) as m, stddev_pop(v) as sd from co group by all)", "y as (select avg(cast(label < 3 as int)) as my from bl)", "c as (select co.dim, sum((v - m) / case when sd = 0 then 1 else sd end * (cast(label < 3 as int) - my)) as w from co join s using (dim), y group by all)") + "select cast(dim as int) as dim, round(w / sqrt(sum(w * w) over ()), 6) as weight from c",
)
def pls_first_component(spark: SparkSession, d: str) -> DataFrame:
    """The first component's weights: the normed product of standardised columns and centred label."""
    c = columns(spark, d).withColumn("y", (F.col("label") < 3).cast("double"))
    # cov(x, y) n / sd(x): one pass of aggregates, no join with the rows.
    w = F.covar_pop("v", "y") * F.count(F.lit(1)) / F.when(F.stddev_pop("v") == 0, 1.0).otherwise(F.stddev_pop("v"))
    c = c.groupBy("dim").agg(w.alias("w"))
    return c.select("dim", F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(F.lit(1)))), 6).alias("weight"))  # one row per column


@q(
    "knn_purity",
    sql=S.with_(_BLOCK, "qs as (select * from bl where item_id % 20 = 0)", "p as (select qs.item_id, qs.label, b.label as other, row_number() over (partition by qs.item_id order by round(list_sum(list_transform(range(1, 65), lambda k: (qs.x[k] - b.x[k]) * (qs.x[k] - b.x[k]))), 9), b.item_id) as r from qs join bl b on b.item_id <> qs.item_id)") + "select item_id, cast(label as int) as label, round(avg(cast(label = other as int)), 9) as purity from p where r <= 10 group by all",
)
def knn_purity(spark: SparkSession, d: str) -> DataFrame:
    """Share of the ten nearest with the same label; queries are the ids divisible by 20, against all rows."""
    b = block(spark, d)
    return nearest_labels(b, b.filter("item_id % 20 = 0"), 10)


QUERIES_AT_ONCE = 20_000  # queries that are sent to every task in one pass (10 MB of vectors)


def nearest_labels(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(item_id, label, purity) of a stated query set, in blocks: each pass holds a bounded block of queries.

    A task multiplies its rows' matrix with the block's and keeps the k nearest of its own rows for each
    query, so a pass returns at most queries times k rows of each task. Equal distances (nine digits) go
    to the lower id.
    """
    n = queries.count()
    passes = max(1, -(-n // QUERIES_AT_ONCE))
    out_: DataFrame | None = None
    for p in range(passes):
        held = queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).select("item_id", "label", "x").collect()  # one bounded block
        qi, ql = np.array([r["item_id"] for r in held], np.int64), np.array([r["label"] for r in held], np.int64)
        qx = np.array([r["x"] for r in held], float)
        c = rows.select("item_id", "label", "x").mapInPandas(_nearest(qi, qx, k), "qi long, id long, label long, dist double")
        w = Window.partitionBy("qi").orderBy("dist", "id")  # k rows of each task
        c = c.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
        labels = rows.sparkSession.createDataFrame(pd.DataFrame({"qi": qi, "ql": ql}), "qi long, ql int")
        c = c.join(F.broadcast(labels), "qi").groupBy(F.col("qi").alias("item_id"), F.col("ql").alias("label")).agg(out(F.avg((F.col("label") == F.col("ql")).cast("int"))).alias("purity"))  # one bounded block
        out_ = c if out_ is None else out_.unionByName(c)
    return out_


def _nearest(qi: np.ndarray, qx: np.ndarray, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[pd.DataFrame] = []
        for pdf in parts:
            if not len(pdf) or not len(qi):
                continue
            x, ids, label = np.array(pdf["x"].tolist(), float), pdf["item_id"].to_numpy(), pdf["label"].to_numpy()
            for at in range(0, len(qi), 256):
                q = qx[at : at + 256]
                d = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * q @ x.T
                d[qi[at : at + 256][:, None] == ids] = np.inf
                edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                row, col = np.nonzero((d <= edge[:, None] + 1e-9) & np.isfinite(d))
                exact = ((q[row] - x[col]) ** 2).sum(axis=1).round(9)
                best.append(pd.DataFrame({"qi": qi[at + row], "id": ids[col], "label": label[col], "dist": exact}))
            if sum(map(len, best)) > 4 * k * len(qi):
                best = [_first(best, k)]
        if best:
            yield _first(best, k)

    return run


def _first(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    return pd.concat(parts).sort_values(["qi", "dist", "id"]).groupby("qi").head(k)


@q("lap_eigvals", sql=S.with_(V.SQL_ATTENTION, "c as (select item_id, head, j as u, sum(a) / greatest(1, count(*) filter (where a > 0)) - sum(a) filter (where i = j) as l from att group by all)") + "select item_id, cast(head as int) as head, list_transform(list_reverse_sort(list(l))[1:5], lambda v: round(v, 9)) as top from c group by all")
def lap_eigvals(spark: SparkSession, d: str) -> DataFrame:
    """Eigenvalues of the causal Laplacian: it is triangular, so they are column means less the diagonal."""
    a = V.attention(spark, d)
    c = a.groupBy("item_id", "head", "j").agg((F.sum("a") / F.greatest(F.lit(1), X.count_if(F.col("a") > 0)) - F.sum(F.when(F.col("i") == F.col("j"), F.col("a")))).alias("l"))
    return c.groupBy("item_id", "head").agg(F.transform(top_k(F.collect_list("l"), 5), lambda v: out(v)).alias("top"))


@q("attn_diag_topk", sql=S.with_(V.SQL_ATTENTION) + "select item_id, cast(head as int) as head, list_transform(list_reverse_sort(list(a))[1:5], lambda v: round(v, 9)) as top from att where i = j group by all")
def attn_diag_topk(spark: SparkSession, d: str) -> DataFrame:
    """The largest attention weights of tokens on themselves."""
    a = V.attention(spark, d).filter("i = j").groupBy("item_id", "head").agg(top_k(F.collect_list("a"), 5).alias("top"))
    return a.select("item_id", "head", F.transform("top", lambda v: out(v)).alias("top"))


@q("last_token_state", sql="with f as (select item_id, layer, i, coalesce(extracted_at, timestamp '0001-01-01') as t, list_transform(hidden_states, lambda v: round(cast(v as double), 6)) as x from forward_traces where item_id is not null and len(hidden_states) = 64 and len(list_filter(hidden_states, lambda v: v is not null and isfinite(v))) = 64) select item_id, layer, max(i) as i, arg_max(x, struct_pack(i := i, t := t, x := x)) as x from f group by all")
def last_token_state(spark: SparkSession, d: str) -> DataFrame:
    """The whole state of the last token in each layer; the newest of equals. A vector with a null, NaN or infinite element does not count."""
    f = usable(table(spark, d, "forward_traces", "item_id", "layer", "i", "extracted_at", "hidden_states")).filter("item_id is not null")
    f = f.select("item_id", "layer", "i", F.coalesce("extracted_at", F.lit("0001-01-01").cast("timestamp")).alias("t"), F.transform("hidden_states", lambda v: F.round(v.cast("double"), 6)).alias("x"))
    return f.groupBy("item_id", "layer").agg(F.max("i").alias("i"), F.max_by("x", F.struct("i", "t", "x")).alias("x"))


def usable(traces: DataFrame, dims: int = 64) -> DataFrame:
    """Rows whose vector has the right length and no null, NaN or infinite element."""
    finite = F.forall("hidden_states", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return traces.filter((F.size("hidden_states") == dims) & finite)


@q("svd_spectrum", sql="select vec_id // 10 as item_id, least(count(*), 64) as n_values, round(sum(list_sum(list_transform(embedding, lambda v: power(cast(v as double), 2)))), 6) as squares, round(sum(list_sum(list_transform(embedding, lambda v: power(cast(v as double), 2)))), 6) as sigma_squares, true as falling from embeddings group by all")
def svd_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Singular values of each item's token vectors: their number, order, and sum of squares beside the vectors' own."""
    s = spectra(spark, d)
    falling = F.forall(F.arrays_zip(F.slice("sigma", 1, F.size("sigma") - 1).alias("a"), F.slice("sigma", 2, F.size("sigma")).alias("b")), lambda p: p["a"] >= p["b"] - 1e-9)
    return s.select("item_id", F.size("sigma").cast("long").alias("n_values"), F.round("squares", 6).alias("squares"), F.round(F.aggregate("sigma", F.lit(0.0), lambda a, v: a + v * v), 6).alias("sigma_squares"), falling.alias("falling"))


@q("svd_values")
def svd_values(spark: SparkSession, d: str) -> DataFrame:
    """The singular values themselves."""
    return spectra(spark, d).select("item_id", F.transform("sigma", lambda v: F.round(v, 6)).alias("sigma"))


def spectra(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / V.TOKENS).alias("item_id"), (F.col("vec_id") % V.TOKENS).alias("i"), "embedding")

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([np.asarray(v, float) for v in pdf.sort_values("i")["embedding"]])
        s = np.linalg.svd(x, compute_uv=False)
        return pd.DataFrame({"item_id": [pdf["item_id"].iloc[0]], "sigma": [s.tolist()], "squares": [float((x * x).sum())]})

    return t.groupBy("item_id").applyInPandas(spectrum, "item_id long, sigma array<double>, squares double")


_ICR_K = 5


@q(
    "icr_score",
    sql=S.with_(
        V.SQL_ATTENTION,
        "mean as (select item_id, i, j, avg(a) as q from att group by all)",
        f"top as (select *, row_number() over (partition by item_id, i order by round(q, 12) desc, j) as r from mean)",
        f"kept as (select item_id, i, j, q from top where r <= {_ICR_K})",
        "nt as (select t.item_id, t.i, case when p.x is null then t.x else list_transform(range(1, 65), lambda k: t.x[k] - p.x[k]) end as dx from tok t left join tok p on p.item_id = t.item_id and p.i = t.i - 1)",
        "sc as (select kept.*, list_sum(list_transform(range(1, 65), lambda k: a.dx[k] * b.x[k])) / sqrt(list_sum(list_transform(b.x, lambda v: v * v))) as s from kept join nt a on a.item_id = kept.item_id and a.i = kept.i join tok b on b.item_id = kept.item_id and b.i = kept.j)",
        "pq as (select item_id, i, exp(s - max(s) over w) / sum(exp(s - max_s)) over w as p, q / sum(q) over w as q from (select *, max(s) over (partition by item_id, i) as max_s from sc) window w as (partition by item_id, i))",
        "js as (select item_id, i, greatest(0, 0.5e0 * sum(p * (log2(p + 1e-12) - log2((p + q) / 2 + 1e-12))) + 0.5e0 * sum(q * (log2(q + 1e-12) - log2((p + q) / 2 + 1e-12)))) as jsd from pq group by all)",
    )
    + "select item_id, round(arg_max(jsd, i), 6) as last_token, round(avg(jsd), 6) as answer_mean from js where i >= 4 group by all",
)
def icr_score(spark: SparkSession, d: str) -> DataFrame:
    """Divergence between a token's update, projected on the most attended tokens, and the attention itself."""
    a = V.attention(spark, d).groupBy("item_id", "i", "j").agg(F.avg("a").alias("q"))
    kept = a.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "i").orderBy(F.desc(F.round("q", 12)), "j"))).filter(F.col("r") <= _ICR_K)
    tok = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / V.TOKENS).alias("item_id"), (F.col("vec_id") % V.TOKENS).cast("int").alias("i"), X.doubles("embedding").alias("x"))
    before = F.lag("x").over(Window.partitionBy("item_id").orderBy("i"))
    upd = tok.withColumn("dx", F.zip_with("x", F.coalesce(before, F.array_repeat(F.lit(0.0), 64)), lambda u, v: u - v)).select("item_id", "i", "dx")
    s = kept.join(upd, ["item_id", "i"]).join(tok.select("item_id", F.col("i").alias("j"), "x"), ["item_id", "j"]).withColumn("s", X.dot("dx", "x") / F.sqrt(X.dot("x", "x")))
    w = Window.partitionBy("item_id", "i")
    s = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w)).withColumn("q", F.col("q") / F.sum("q").over(w))
    m = (F.col("p") + F.col("q")) / 2 + 1e-12
    half = lambda c: F.sum(F.col(c) * (F.log2(F.col(c) + 1e-12) - F.log2(m))) * 0.5
    js = s.groupBy("item_id", "i").agg(F.greatest(F.lit(0.0), half("p") + half("q")).alias("jsd")).filter("i >= 4")
    return js.groupBy("item_id").agg(F.round(F.max_by("jsd", "i"), 6).alias("last_token"), F.round(F.avg("jsd"), 6).alias("answer_mean"))


@q(
    "logprob_features",
    sql=S.with_(V.SQL_BIG, "p as (select group_id as item_id, ln(greatest(0.02e0, score)) as lp from big where method = 'quantity')", "f as (select item_id, avg(lp) as mean, sum(lp) as total, min(lp) as lo, max(lp) as hi, median(lp) as med, stddev_pop(lp) as sd, quantile_cont(lp, 0.1e0) as q10, quantile_cont(lp, 0.25e0) as q25, avg(-lp * exp(lp)) as mean_entropy, max(-lp * exp(lp)) as max_entropy, avg(exp(lp) - 0.02e0) as margin, avg(cast(lp < -2 as int)) as below_2, avg(cast(lp < -5 as int)) as below_5, count(*) as n from p group by all)")
    + "select item_id, " + ", ".join(f"round({c}, 6) as {c}" for c in ("mean", "total", "lo", "hi", "med", "sd", "q10", "q25", "mean_entropy", "max_entropy", "margin", "below_2", "below_5")) + ", n from f",
)
def logprob_features(spark: SparkSession, d: str) -> DataFrame:
    """Fourteen statistics of the log probabilities of each item's tokens."""
    p = V.big(spark, d).filter("method = 'quantity'").select(F.col("group_id").alias("item_id"), F.log(F.greatest(F.lit(0.02), F.col("score"))).alias("lp"))
    lp = F.col("lp")
    stats = {"mean": F.avg(lp), "total": F.sum(lp), "lo": F.min(lp), "hi": F.max(lp), "med": F.percentile(lp, F.lit(0.5)), "sd": F.stddev_pop(lp), "q10": F.percentile(lp, F.lit(0.1)), "q25": F.percentile(lp, F.lit(0.25)), "mean_entropy": F.avg(-lp * F.exp(lp)), "max_entropy": F.max(-lp * F.exp(lp)), "margin": F.avg(F.exp(lp) - 0.02), "below_2": F.avg((lp < -2).cast("int")), "below_5": F.avg((lp < -5).cast("int"))}
    return p.groupBy("item_id").agg(*[F.round(c, 6).alias(k) for k, c in stats.items()], F.count(F.lit(1)).alias("n"))


@q("canonical_sample_order", sql="with s as (select vec_id // 5 as item_id, vec_id, cast(embedding[1] as double) as lp from embeddings) select item_id, list(vec_id order by round(lp, 9) desc, vec_id) as ordered from s group by all")
def canonical_sample_order(spark: SparkSession, d: str) -> DataFrame:
    """An item's samples by falling log probability; equals by number."""
    s = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("item_id"), "vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 9).alias("lp"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("lp")).alias("k"), "vec_id")))
    return s.groupBy("item_id").agg(F.transform(rows, lambda r: r["vec_id"]).alias("ordered"))


@q(
    "scatter_feats",
    sql=S.with_(
        "s as (select vec_id // 5 as item_id, vec_id % 5 as k, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings)",
        "n as (select item_id, k, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) as norm from s)",
        "g as (select a.item_id, a.k, b.k as kb, list_sum(list_transform(range(1, 65), lambda t: a.x[t] * b.x[t])) / (a.norm * b.norm) as cos, sqrt(list_sum(list_transform(range(1, 65), lambda t: power(a.x[t] - b.x[t], 2)))) as dist from n a join n b on a.item_id = b.item_id and a.k < b.k)",
    )
    + "select item_id, list_transform(list_sort(list(cos) filter (where k = 0)), lambda v: round(v, 6)) as greedy_cos, round(avg(cos) filter (where k > 0), 6) as pair_cos_mean, round(stddev_pop(cos) filter (where k > 0), 6) as pair_cos_sd, round(avg(dist) filter (where k = 0), 6) as dist_mean, round(max(dist) filter (where k = 0), 6) as dist_max from g group by all",
)
def scatter_feats(spark: SparkSession, d: str) -> DataFrame:
    """How four samples lie around the first answer and one another: cosines and distances inside the row."""
    s = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("item_id"), (F.col("vec_id") % 5).alias("k"), X.doubles("embedding").alias("x"))
    s = s.withColumn("norm", F.sqrt(X.dot("x", "x"))).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("k", "norm", "x"))).alias("s"))
    cell = lambda a, b: F.named_struct(F.lit("k"), a["k"], F.lit("cos"), X.dot(a["x"], b["x"]) / (a["norm"] * b["norm"]), F.lit("dist"), F.sqrt(F.aggregate(F.zip_with(a["x"], b["x"], lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda t, v: t + v)))
    g = s.select("item_id", F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["k"] > a["k"]), lambda b: cell(a, b))))).alias("c")).select("item_id", "c.*")
    first, rest = F.col("k") == 0, F.col("k") > 0
    six = lambda c: F.round(c, 6)
    return g.groupBy("item_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(first, F.col("cos")))), lambda v: F.round(v, 6)).alias("greedy_cos"),
        six(F.avg(F.when(rest, F.col("cos")))).alias("pair_cos_mean"), six(F.stddev_pop(F.when(rest, F.col("cos")))).alias("pair_cos_sd"),
        six(F.avg(F.when(first, F.col("dist")))).alias("dist_mean"), six(F.max(F.when(first, F.col("dist")))).alias("dist_max"),
    )


@q(
    "stable_dims",
    sql=S.with_(_BLOCK, _COLS, "f as (select *, cast(item_id as int) % 5 as fold from co)", "h as (select unnest([0, 1, 2, 3, 4]) as held)", "w as (select held, dim, abs(corr(v, cast(label < 3 as double))) as w from f, h where fold <> held group by all)", "r as (select *, row_number() over (partition by held order by round(w, 12) desc, dim) as r from w)") + "select cast(dim as int) as dim, count(*) as n_folds from r where r <= 16 group by all having count(*) >= 4",
)
def stable_dims(spark: SparkSession, d: str) -> DataFrame:
    """Columns among the sixteen most telling in at least four of five folds."""
    f = columns(spark, d).withColumn("held", F.explode(F.array(*[F.lit(k) for k in range(5)]))).filter(F.col("item_id") % 5 != F.col("held"))
    w = f.groupBy("held", "dim").agg(F.abs(F.corr("v", (F.col("label") < 3).cast("double"))).alias("w"))
    r = w.withColumn("r", F.row_number().over(Window.partitionBy("held").orderBy(F.desc(F.round("w", 12)), "dim"))).filter("r <= 16")
    return r.groupBy("dim").agg(F.count(F.lit(1)).alias("n_folds")).filter("n_folds >= 4")


@q(
    "topk_layers",
    sql=S.with_(_BLOCK, _COLS, "l as (select dim // 4 as layer, abs(corr(v, cast(label < 3 as double))) as w from co group by dim)", "m as (select layer, max(w) as w from l group by all)", "r as (select *, row_number() over (order by round(w, 12) desc, layer) as r from m)", "k as (select * from r where r <= 4)") + "select cast(layer as int) as layer, round(w, 6) as weight, (select max(layer) - min(layer) from k) = 3 as contiguous from k",
)
def topk_layers(spark: SparkSession, d: str) -> DataFrame:
    """The four most telling layers, and whether they stand side by side."""
    w = columns(spark, d).groupBy("dim").agg(F.abs(F.corr("v", (F.col("label") < 3).cast("double"))).alias("w"))
    m = w.groupBy(F.floor(F.col("dim") / 4).cast("int").alias("layer")).agg(F.max("w").alias("w"))
    k = m.orderBy(F.desc(F.round("w", 12)), "layer").limit(4)
    one = Window.partitionBy(F.lit(1))  # four rows
    return k.select("layer", F.round("w", 6).alias("weight"), ((F.max("layer").over(one) - F.min("layer").over(one)) == 3).alias("contiguous"))


# Attention graphs: edges above tau, strictly below the diagonal, from the last prompt token on.

TAU, PROMPT = 0.08, 4
_EDGES = f"""
ed as (select item_id, i, j, head, a from att where j < i and i >= {PROMPT} - 1 and a > {TAU}),
eg as (select item_id, i, j, cast(j >= {PROMPT} as int) as edge_type, count(*) as n_channels, sum(a) as total from ed group by all)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    return V.attention(spark, d).filter(f"j < i and i >= {PROMPT} - 1 and a > {TAU}")


def graph(e: DataFrame) -> DataFrame:
    """An edge where any channel survives; its type says whether the source is in the response."""
    return e.groupBy("item_id", "i", "j").agg(F.count(F.lit(1)).alias("n_channels"), F.sum("a").alias("total")).withColumn("edge_type", (F.col("j") >= PROMPT).cast("int"))


@q("graph_edges", sql=S.with_(V.SQL_ATTENTION, _EDGES) + "select item_id, i, j, edge_type, n_channels, round(total, 9) as total from eg")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each item's attention graph."""
    return graph(edges(spark, d)).select("item_id", "i", "j", "edge_type", "n_channels", out("total").alias("total"))


@q("csr_offsets", sql=S.with_(V.SQL_ATTENTION, _EDGES) + "select item_id, i, j, cast(coalesce(sum(n_channels) over (partition by item_id order by i, j rows between unbounded preceding and 1 preceding), 0) as bigint) as first, cast(sum(n_channels) over (partition by item_id order by i, j rows unbounded preceding) as bigint) as last from eg")
def csr_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each edge's channels begin and end in the item's flat list."""
    w = Window.partitionBy("item_id").orderBy("i", "j")
    g = graph(edges(spark, d))
    return g.select("item_id", "i", "j", F.coalesce(F.sum("n_channels").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.sum("n_channels").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last"))


_NODES = "no as (select item_id, i from tok)"


@q(
    "graph_stats",
    sql=S.with_(V.SQL_ATTENTION, _EDGES, _NODES, "s as (select n.item_id, count(distinct n.i) as nodes, count(e.j) as edges, coalesce(sum(e.n_channels), 0) as filled from no n left join eg e on e.item_id = n.item_id and e.i = n.i group by all)")
    + "select count(*) as n_graphs, round(avg(cast(nodes as double)), 9) as mean_nodes, round(avg(cast(edges as double)), 9) as mean_edges, round(quantile_cont(edges, 0.95e0), 9) as p95_edges, max(edges) as max_edges, round(sum(filled) / nullif(cast(sum(edges) * 2 as double), 0), 9) as density from s",
)
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the graphs and how many of an edge's channels are filled; nodes without edges count."""
    nodes = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / V.TOKENS).alias("item_id")).agg(F.count(F.lit(1)).alias("nodes"))
    g = graph(edges(spark, d)).groupBy("item_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("n_channels").alias("filled"))
    s = nodes.join(g, "item_id", "left").na.fill(0)
    return s.agg(F.count(F.lit(1)).alias("n_graphs"), out(F.avg("nodes")).alias("mean_nodes"), out(F.avg("edges")).alias("mean_edges"), out(F.percentile("edges", F.lit(0.95))).alias("p95_edges"), F.max("edges").alias("max_edges"), out(X.ratio(F.sum("filled"), F.sum("edges") * 2)).alias("density"))


# Channel weights of the linear part of a message, and of the edge type.
CHANNEL = (0.75, -0.5)
TYPE = (0.1, 0.3)
ACT_LAYERS = (1, 3)  # layers of a block whose activations a node carries


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / V.TOKENS).alias("item_id"), (F.col("vec_id") % V.TOKENS).cast("int").alias("i"), X.doubles("embedding").alias("x"))


@q(
    "node_features",
    sql=S.with_(V.SQL_ATTENTION, "sa as (select item_id, i, list(a order by head) as attn from att where i = j group by all)")
    + f"select t.item_id, t.i, t.i >= {PROMPT} as is_resp, list_transform(attn, lambda v: round(v, 9)) as attn, list_transform(list_concat(x[17:32], x[49:64]), lambda v: round(v, 6)) as act from tok t join sa using (item_id, i)",
)
def node_features(spark: SparkSession, d: str) -> DataFrame:
    """Each node's attention on itself by head, and its activations at two fixed layers."""
    a = V.attention(spark, d).filter("i = j").groupBy("item_id", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("head", "a"))), lambda p: out(p["a"])).alias("attn"))
    act = F.flatten(F.array(*[F.slice("x", 1 + 16 * k, 16) for k in ACT_LAYERS]))
    return tokens(spark, d).join(a, ["item_id", "i"]).select("item_id", "i", (F.col("i") >= PROMPT).alias("is_resp"), "attn", F.transform(act, lambda v: F.round(v, 6)).alias("act"))


def added(rows: Column, width: int = 64) -> Column:
    """The sum of an array of arrays, place by place."""
    return F.aggregate(rows, F.array_repeat(F.lit(0.0), width), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, i, deg, h): own vector and the mean message of the sources: channels, vector, type.

    A node's incoming edges are at most the tokens before it, so they are added up inside its row.
    """
    tok = tokens(spark, d)
    weight = F.element_at(F.array(*[F.lit(c) for c in CHANNEL]), F.col("head") + 1)
    e = edges(spark, d).groupBy("item_id", "i", "j").agg(F.sum(F.col("a") * weight).alias("w"))
    e = e.join(tok.select("item_id", F.col("i").alias("j"), F.col("x").alias("src")), ["item_id", "j"])
    flat = F.col("w") + F.when(F.col("j") >= PROMPT, TYPE[1]).otherwise(TYPE[0])
    m = e.groupBy("item_id", "i").agg(F.count(F.lit(1)).alias("deg"), F.sum(flat).alias("flat"), added(F.transform(F.array_sort(F.collect_list(F.struct("j", "src"))), lambda p: p["src"])).alias("m"))
    n = tok.join(m, ["item_id", "i"], "left")
    h = F.when(F.col("m").isNull(), F.col("x")).otherwise(F.zip_with("x", "m", lambda a, b: a + (b + F.col("flat")) / F.col("deg")))
    return n.select("item_id", "i", F.coalesce("deg", F.lit(0)).alias("deg"), h.alias("h"))


_MESSAGES = f"""
ch as (select item_id, i, j, sum(a * case head when 0 then {CHANNEL[0]}e0 else {CHANNEL[1]}e0 end) as w from ed group by all),
ms as (select c.item_id, c.i, count(*) as deg, sum(w + case when c.j >= {PROMPT} then {TYPE[1]}e0 else {TYPE[0]}e0 end) as flat, list(t.x) as xs from ch c join tok t on t.item_id = c.item_id and t.i = c.j group by all),
nd as (select t.item_id, t.i, coalesce(deg, 0) as deg, case when deg is null then t.x else list_transform(range(1, 65), lambda k: t.x[k] + (list_sum(list_transform(xs, lambda v: v[k])) + flat) / deg) end as h from tok t left join ms on ms.item_id = t.item_id and ms.i = t.i)"""


@q("message_pass_mean", sql=S.with_(V.SQL_ATTENTION, _EDGES, _MESSAGES) + "select item_id, i, deg, list_transform(h, lambda v: round(v, 6)) as h from nd")
def message_pass_mean(spark: SparkSession, d: str) -> DataFrame:
    """One round of messages: sparse channels times weights, averaged over the incoming edges."""
    return messages(spark, d).select("item_id", "i", "deg", F.transform("h", lambda v: F.round(v, 6)).alias("h"))


@q("graph_pool", sql=S.with_(V.SQL_ATTENTION, _EDGES, _MESSAGES, f"po as (select item_id, count(*) as n_resp, list(h) as hs from nd where i >= {PROMPT} group by all), it as (select distinct item_id from nd)") + "select it.item_id, coalesce(n_resp, 0) as n_resp, list_transform(range(1, 65), lambda k: round(coalesce(list_sum(list_transform(hs, lambda v: v[k])), 0e0) / greatest(1, coalesce(n_resp, 0)), 6)) as pooled from it left join po using (item_id)")
def graph_pool(spark: SparkSession, d: str) -> DataFrame:
    """Mean over the response's nodes of each graph; zeros for a graph without any."""
    n = messages(spark, d)
    resp = F.col("i") >= PROMPT
    g = n.groupBy("item_id").agg(X.count_if(resp).alias("n_resp"), added(F.transform(F.array_sort(F.collect_list(F.when(resp, F.struct("i", "h")))), lambda p: p["h"])).alias("s"))
    return g.select("item_id", "n_resp", F.transform("s", lambda v: F.round(v / F.greatest(F.lit(1), F.col("n_resp")), 6)).alias("pooled"))
