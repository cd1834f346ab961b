"""Out-of-fold scores of the probes, and analyses that fit models."""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import expressions as X
from tallymill.functions import graphnet
from tallymill.functions import sqltext as S
from tallymill.functions.expressions import order_hash, out
from tallymill.operators import models as M
from tallymill.operators import ranked as R
from tallymill.operators import sampling as G
from tallymill.plans.ensembles import SQL_FOLDED, applied, folded
from tallymill.plans.features import PROMPT, edges, node_features, top_k
from tallymill.plans.metrics import answers_by_item, sql_held_out
from tallymill.registry import CORE
from tallymill.session import cut, shared_folder
from tallymill.sources import views as V
from tallymill.sources.stores import OofStore
from tallymill.sources.tables import table

q = CORE.query
FOLDS = 5


def _recursive(*parts: str) -> str:
    return "with recursive " + ",\n".join(p.strip() for p in parts) + "\n"


# The rows of the probes in SQL, and the report of out-of-fold scores lo.
SQL_ROWS = SQL_FOLDED + ",\nxr as materialized (select wf.item_id, fold, y, list_transform(embedding, lambda v: cast(v as double)) as x from wf join embeddings on vec_id = wf.item_id)"
SQL_REPORT = ("pb as (select 'probe' as method, * from lo)", sql_held_out("pb", "method"), f"rc as (select 'probe' as method, {S.confusion('y', 'cast(score >= threshold as int)')}, count(*) as n from pb join ho using (method, fold) group by all)", S.auroc("pb", "method"))
SQL_REPORT_OUT = f"select n, round(auroc, 9) as auroc, round({S.mcc()}, 9) as mcc from rc join roc using (method)"


def rows(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, dataset, group_id, y, fold, x) of the embedding table."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), X.doubles("embedding").alias("x"))
    w = V.wide(spark, d).select("item_id", "dataset", "group_id", "y")
    w = w.join(G.group_folds(w, FOLDS, "fold"), "group_id")
    return w.join(e, "item_id")


def report(oof: DataFrame) -> DataFrame:
    """AUROC of the out-of-fold scores, and MCC with thresholds held out by folds."""
    p = applied(oof.withColumn("method", F.lit("probe")))
    c = p.groupBy("method").agg(*X.confusion(), F.count(F.lit(1)).alias("n"))
    return c.join(R.auroc(p, ["method"]), "method").select("n", out("auroc").alias("auroc"), out(X.mcc()).alias("mcc"))


def quality(oof: DataFrame) -> DataFrame:
    """(method, n, auroc, mcc) of scores and of the models' own decisions."""
    oof = cut(oof, "scores")
    c = oof.groupBy("method").agg(*X.confusion(), F.count(F.lit(1)).alias("n"))
    return c.join(R.auroc(oof, ["method"]), "method").select("method", "n", out("auroc").alias("auroc"), out(X.mcc()).alias("mcc"))


def _probe(name: str, fit, text: str):  # noqa: ANN001, ANN202
    """A query of out-of-fold scores; ``fit`` is one fit, or a dictionary of fits by method."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        oof = M.sampled_oof(rows(spark, d), fit)
        return oof.select("item_id", "fold", "y", *(["method", "pred"] if isinstance(fit, dict) else []), F.round("score", 6).alias("score"))

    query.__doc__, query.__name__ = text, name
    return q(name)(query)


GRID = [{"c": c} for c in M.C_GRID]
oof_predictions = _probe("oof_predictions", M.fit_tuned, "Logistic regression with its penalty chosen on an inner part.")
pca_logreg = _probe("pca_logreg", M.fit_pca, "Components of the standardised block (512, or as many as there are), then logistic regression.")
blockpca_logreg = _probe("blockpca_logreg", M.fit_block_pca, "Components by block side by side, then logistic regression.")
lda_oof = _probe("lda_oof", M.fit_lda, "Linear discriminant with shrinkage.")
svm_oof = _probe(
    "svm_oof",
    {"linear": lambda x, y, v: M.fit_svm(x, y), "radial": M.nested(M.fit_radial, [{"c": c, "gamma": g} for c in (0.3, 3.0) for g in (0.3, 1.0)])},
    "Support vectors with squared hinge loss: linear, and with a radial kernel chosen on the inner part.",
)
kernel_features = _probe(
    "kernel_features",
    {"fourier": lambda x, y, v: M.fit_fourier(x, y), "nystroem": M.nested(M.fit_nystroem, [{"c": c, "gamma": g} for c in (0.3, 3.0) for g in (0.3, 1.0)])},
    "Random Fourier features and landmark features of a radial kernel, each before a logistic regression.",
)
mlp_oof = _probe(
    "mlp_oof",
    {"wide": lambda x, y, v: M.fit_mlp(x, y, (256, 128, 64)), "narrow": lambda x, y, v: M.fit_mlp(x, y, (128, 64, 32)), "block_encoder": lambda x, y, v: M.fit_mlp(x, y, (32, 32), blocks=[0, 16, 32, 48, 64])},
    "Multi-layer probes of two sizes with early stopping, and one whose first layer is an encoder per block.",
)
gbt_oof = _probe("gbt_oof", M.fit_boosted, "Gradient-boosted trees.")


# The blocks of the detectors, side by side: largest values, largest sizes, four layers, their norms, cosines of neighbours.
EDGES = [0, 16, 32, 96, 100, 103]
_LAYERS = [list(range(32 + 16 * k, 48 + 16 * k)) for k in range(4)]
_BLOCK = [list(range(a, b)) for a, b in zip(EDGES[:-1], EDGES[1:], strict=True)]


def _union(equal: bool, width: int = 8) -> M.Fit:
    """All blocks with one of the layers: as they are, or each brought to the same number of components."""

    def fit(x: np.ndarray, y: np.ndarray, layer: int, c: float) -> tuple[str, dict]:
        cols = [*_BLOCK[0], *_BLOCK[1], *_LAYERS[layer], *_BLOCK[3], *_BLOCK[4]]
        name, p = M.fit_block_pca(x[:, cols], y, k=width, c=c, edges=[0, 16, 32, 48, 52, 55]) if equal else M.fit_logistic(x[:, cols], y, c)
        return name, {**p, "columns": np.array(cols)}

    return M.nested(fit, [{"layer": k, "c": c} for k in (1, 2, 3) for c in M.C_GRID])


DETECTORS: dict[str, M.Fit] = {
    "lapeigvals": M.nested(M.on_columns(M.fit_pca, _BLOCK[0]), [{"k": 512, "c": 1.0}]),
    "attn_baseline": M.nested(M.on_columns(M.fit_logistic, _BLOCK[1]), GRID),
    "svd_baseline": M.nested(M.on_columns(M.fit_logistic, _BLOCK[3]), GRID),
    "saplma": M.nested(M.on_columns(M.fit_mlp), [{"layer": c, "sizes": (256, 128, 64), "epochs": 20} for c in _LAYERS]),
    "icr": M.nested(M.on_columns(M.fit_mlp, _BLOCK[4]), [{"sizes": (128, 64, 32), "epochs": 20}]),
    "union_raw": _union(False),
    "union_equal": _union(True),
}


def blocks(spark: SparkSession, d: str) -> DataFrame:
    r = rows(spark, d)
    layer = [F.slice("x", 1 + 16 * k, 16) for k in range(4)]
    norm = [F.sqrt(X.dot(c, c)) for c in layer]
    cosine = [F.coalesce(X.dot(a, b) / F.nullif(m * n, F.lit(0.0)), F.lit(0.0)) for a, b, m, n in zip(layer, layer[1:], norm, norm[1:], strict=False)]
    return r.withColumn("x", F.concat(top_k("x", 16), top_k(F.transform("x", lambda v: F.abs(v)), 16), "x", F.array(*norm), F.array(*cosine)))


@q("detector_oof")
def detector_oof(spark: SparkSession, d: str) -> DataFrame:
    """Every detector by the nested protocol: inner choice, threshold, a fit on all training rows, out-of-fold scores and decisions."""
    return M.sampled_oof(blocks(spark, d), DETECTORS).select("item_id", "fold", "y", "method", F.round("score", 6).alias("score"), "pred")


@q("detector_report")
def detector_report(spark: SparkSession, d: str) -> DataFrame:
    """Quality of every detector, from its stored out-of-fold scores, which all queries on predictions can read."""
    store = OofStore(spark, f"{shared_folder(spark)}/oof-{uuid.uuid4().hex}")
    oof = cut(M.sampled_oof(blocks(spark, d), DETECTORS), "oof")
    items = rows(spark, d).select("item_id", "dataset", "group_id")
    for m in DETECTORS:
        store.save(oof.filter(F.col("method") == m).drop("method").join(items, "item_id"), "r0", 0, m)
    return quality(store.load("r0").select("item_id", "fold", "y", "method", "score", "pred"))


@q("logreg_oof", sql=_recursive(SQL_ROWS, S.logistic("xr", 64, steps=8)) + "select item_id, cast(fold as int) as fold, cast(y as int) as y, round(score, 6) as score from lo")
def logreg_oof(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression over all rows, every fold in the same passes."""
    return M.logistic_oof(rows(spark, d)).select("item_id", "fold", "y", F.round("score", 6).alias("score"))


@q("probe_report", sql=_recursive(SQL_ROWS, S.logistic("xr", 64, steps=8), *SQL_REPORT) + SQL_REPORT_OUT)
def probe_report(spark: SparkSession, d: str) -> DataFrame:
    """Quality of the logistic probe's out-of-fold scores."""
    return report(M.logistic_oof(rows(spark, d)))


@q(
    "length_probe",
    sql=_recursive(V.SQL_PREDICTIONS, "an as (select item_id, max(answer_tokens) as tokens from answers group by all)", "ib as (select item_id, max(y) as y, max(fold) as fold from pred group by all)", "xr as materialized (select item_id, fold, y, [ln(1e0 + tokens)] as x from ib join an using (item_id) where tokens is not null)", S.logistic("xr", 1), *SQL_REPORT)
    + SQL_REPORT_OUT,
)
def length_probe(spark: SparkSession, d: str) -> DataFrame:
    """How much the answer's length alone tells: one column, over the real items."""
    p = V.predictions(spark, d).groupBy("item_id").agg(F.max("y").alias("y"), F.max("fold").alias("fold"))
    x = p.join(answers_by_item(spark, d).filter("tokens is not null"), "item_id").select("item_id", "fold", "y", F.array(F.log1p(F.col("tokens").cast("double"))).alias("x"))
    return report(M.logistic_oof(x))


@q("layer_sweep")
def layer_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Probes on each of four layers, and on layers that each training part chooses for itself on its validating rows."""
    r = rows(spark, d)
    every = M.logistic_oof(r, arms={f"layer_{k}": list(range(16 * k, 16 * k + 16)) for k in range(4)})
    fits = {"best_single": M.layer_mix(16, 1), "mix_of_2": M.layer_mix(16, 2)}
    fits |= {f"last_{k}_{m}": M.last_layers(16, k, m) for k in (2, 3) for m in ("per_layer", "budget", "joint")}
    return quality(every.unionByName(M.sampled_oof(r, fits)))


@q("stacking_forward")
def stacking_forward(spark: SparkSession, d: str) -> DataFrame:
    """Greedy forward selection of methods for a stacked probe: the best next one at each size."""
    w = V.wide(spark, d)
    base = cut(w.join(G.group_folds(w, FOLDS, "fold"), "group_id").withColumn("x", F.array(*V.METHODS)), "methods")
    chosen: list[str] = []
    curve = []
    while len(chosen) < len(V.METHODS):
        trial = {m: [V.METHODS.index(c) for c in [*chosen, m]] for m in V.METHODS if m not in chosen}
        scores = {r["method"]: r["auroc"] for r in R.auroc(cut(M.logistic_oof(base, steps=6, arms=trial), "arms"), ["method"]).collect()}
        best = max(sorted(scores), key=lambda m: round(scores[m], 9))
        chosen.append(best)
        curve.append((len(chosen), best, round(float(scores[best]), 6)))
    return spark.createDataFrame(curve, "size int, added string, auroc double")


def _pls(mean: np.ndarray, sd: np.ndarray, second: np.ndarray, components: int) -> list[np.ndarray]:
    """Coefficients on standardised columns after each component; the label is the last column of the moments."""
    cov = (second - np.outer(mean, mean)) / np.outer(sd, sd)
    s, c = cov[:-1, :-1], cov[:-1, -1]
    r, ws, coef, out_ = c.copy(), [], np.zeros(len(c)), []
    for _ in range(components):
        w = r / max(float(np.linalg.norm(r)), 1e-12)
        for v in ws:  # directions that are uncorrelated with the earlier ones
            w = w - v * float(v @ s @ w) / max(float(v @ s @ v), 1e-12)
        load = float(w @ c) / max(float(w @ s @ w), 1e-12)
        r = r - s @ w * load
        coef = coef + w * load
        ws.append(w)
        out_.append(coef.copy())
    return out_


def _sql_pls(components: int = 4) -> str:
    """CTEs that end in p4(kind, held, …, coef1 … coef4): every step is a list expression on a row per kind and fold."""
    dot, d = "list_dot_product", range(1, 65)
    times = lambda w: f"list_transform(s, lambda r: list_dot_product(r, {w}))"
    parts = ["p0 as materialized (select kind, held, s, c, mean, sd, c as r, list_transform(c, lambda v: 0e0) as coef0 from mo)"]
    for k in range(1, components + 1):
        w, src = f"list_transform(r, lambda v: v / greatest(sqrt({dot}(r, r)), 1e-12))", f"p{k - 1}"
        parts.append(f"w{k}_0 as materialized (select *, {w} as w from {src})")
        for j in range(1, k):
            parts.append(f"w{k}_{j} as materialized (select * exclude (w), list_transform(range(1, {len(d) + 1}), lambda i: w[i] - v{j}[i] * {dot}(v{j}, {times('w')}) / greatest({dot}(v{j}, {times(f'v{j}')}), 1e-12)) as w from w{k}_{j - 1})")
        parts.append(f"l{k} as materialized (select *, {times('w')} as sw, {dot}(w, c) / greatest({dot}(w, {times('w')}), 1e-12) as f from w{k}_{k - 1})")
        parts.append(f"p{k} as materialized (select * exclude (w, sw, f, r), list_transform(range(1, {len(d) + 1}), lambda i: r[i] - sw[i] * f) as r, w as v{k}, list_transform(range(1, {len(d) + 1}), lambda i: coef{k - 1}[i] + w[i] * f) as coef{k} from l{k})")
    return ",\n".join(parts)


@q(
    "supervised_components",
    sql=S.with_(
        SQL_ROWS, "ra as (select avg(cast(y as double)) as rate from xr)",
        "zr as materialized (select item_id, fold, unnest([{'kind': 'real', 't': cast(y as double)}, {'kind': 'null', 't': cast(cast(('0x' || substr(md5('null:' || item_id), 1, 8)) as bigint) / 4294967296e0 < rate as int)}], recursive := true), x from xr, ra)",
        "fo as (select distinct fold as held from xr)",
        "zx as materialized (select kind, fold, list_append(x, cast(t as double)) as x from zr)",
        "ms as materialized (select kind, held, i, avg(x[i]) as m, stddev_pop(x[i]) as sd from zx join fo on fold <> held, (select unnest(range(1, 66)) as i) group by all)",
        "sc as materialized (select kind, held, list(m order by i) as mean, list(case when sd > 1e-12 then sd else 1e0 end order by i) as sd from ms group by all)",
        "zz as materialized (select z.kind, c.held, list_transform(range(1, 66), lambda i: (x[i] - mean[i]) / sd[i]) as u from zx z join sc c on c.kind = z.kind and c.held <> z.fold)",
        "co as (select kind, held, i, j, avg(u[i] * u[j]) as v from zz, (select unnest(range(1, 65)) as i), (select unnest(range(1, 66)) as j) group by all)",
        "ro as (select kind, held, i, list(v order by j) filter (where j <= 64) as r, max(v) filter (where j = 65) as c from co group by all)",
        "mo as materialized (select kind, held, list(r order by i) as s, list(c order by i) as c, any_value(mean) as mean, any_value(sd) as sd from ro join sc using (kind, held) group by all)",
        _sql_pls(),
        "mm as (select kind, held, mean, sd, unnest([1, 2, 3, 4]) as component, unnest([coef1, coef2, coef3, coef4]) as w from p4)",
        "ft as (select m.kind, component, case when z.fold = m.held then 'held_out' else 'train' end as part, x[65] as t, list_dot_product(list_transform(range(1, 65), lambda i: (x[i] - mean[i]) / sd[i]), w) * sd[65] + mean[65] as s from zx z join mm m on m.kind = z.kind)",
        "e as (select kind, component, part, 1 - sum(power(t - s, 2)) / nullif(var_pop(t) * count(*), 0) as r2 from ft group by all)",
    )
    + "select kind as labels, cast(component as int) as component, round(max(r2) filter (where part = 'train'), 6) as r2_train, round(max(r2) filter (where part = 'held_out'), 6) as r2_held_out from e group by all",
)
def supervised_components(spark: SparkSession, d: str) -> DataFrame:
    """Partial least squares by fold: the label's variance that each number of components explains, in training and held out, beside labels dealt at random.

    All folds' moments come from one pass; the components follow from them on the driver. The null's
    labels are dealt by a hash with the rate of the real ones, so no row has to be moved.
    """
    b = rows(spark, d).filter("y is not null")
    rate = b.agg(F.avg("y")).first()[0] or 0.0
    dealt = F.conv(F.substring(order_hash(F.lit("null"), F.col("item_id").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0 < rate
    kinds = {"real": F.col("y").cast("double"), "null": dealt.cast("double")}
    out_ = None
    for kind, label in kinds.items():
        z = cut(b.select("item_id", "fold", "y", F.concat("x", F.array(label)).alias("x")), "labelled")
        folds = sorted(r[0] for r in z.select("fold").distinct().collect())
        models = {}
        for held, (mean, sd, second, _) in M.moments(z, folds).items():
            models[held] = [(str(k + 1), "regression", {"mean": mean, "sd": sd, "w": w}) for k, w in enumerate(_pls(mean, sd, second, 4))]
        train = {h: [m for f, own in models.items() if f != h for m in own] for h in folds}  # a row is in the training part of every other fold
        both = _fitted(z, models, True).unionByName(_fitted(z, train, False)).withColumn("labels", F.lit(kind))
        out_ = both if out_ is None else out_.unionByName(both)
    e = out_.groupBy("labels", "component", "part").agg((1 - F.sum((F.col("t") - F.col("s")) * (F.col("t") - F.col("s"))) / F.nullif(F.var_pop("t") * F.count(F.lit(1)), F.lit(0.0))).alias("r2"))
    return e.groupBy("labels", "component").agg(F.round(F.max(F.when(F.col("part") == "train", F.col("r2"))), 6).alias("r2_train"), F.round(F.max(F.when(F.col("part") == "held_out", F.col("r2"))), 6).alias("r2_held_out"))


def _fitted(z: DataFrame, models: dict[int, list[tuple[str, str, dict]]], held: bool) -> DataFrame:
    """(component, part, t, s): labels and fitted values by the models given for each fold."""

    def run(parts):  # noqa: ANN001, ANN202
        for pdf in parts:
            if not len(pdf):
                continue
            x, f = M.matrix(pdf["x"]), pdf["fold"].to_numpy()
            for fold, own_models in models.items():
                own = f == fold
                for name, _, p in own_models if own.any() else []:
                    u = (x[own] - p["mean"]) / p["sd"]
                    yield pd.DataFrame({"component": int(name), "part": "held_out" if held else "train", "t": x[own][:, -1], "s": u[:, :-1] @ p["w"] * p["sd"][-1] + p["mean"][-1]})

    return z.select("fold", "x").mapInPandas(run, "component int, part string, t double, s double")


@q("kmeans_clusters")
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    """k-means of the embedding table: sizes, rates and the main data set of each cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    b = rows(spark, d).withColumn("features", array_to_vector("x"))
    model = KMeans(k=8, seed=7, maxIter=20, initMode="k-means||").fit(b.select("features"))
    k = model.transform(b).groupBy(F.col("prediction").alias("cluster"), "dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    return k.groupBy("cluster").agg(F.sum("n").alias("n"), out(F.sum("pos") / F.sum("n").cast("double")).alias("rate"), F.max_by("dataset", F.struct("n", "dataset")).alias("main_dataset"))


_FLIPS = [round(0.3 + 0.05 * k, 2) for k in range(14)]


@q(
    "two_stage_corrector",
    sql=_recursive(
        SQL_ROWS, S.logistic("xr", 64, steps=8), "jr as materialized (select xr.item_id, xr.fold, xr.y as truth, x, cast(score >= 0.5e0 as int) as d1 from xr join lo using (item_id))",
        "x2 as materialized (select item_id, fold, cast(d1 <> truth as int) as y, x from jr)", S.logistic("x2", 64, "l2", c=0.03, steps=8),
        "vr as (select jr.fold, truth as y, d1, round(l2.score, 9) as w from jr join l2 using (item_id))", f"gr as (select unnest([{', '.join(f'{t}e0' for t in _FLIPS)}]) as t)", "hr as (select distinct fold as held from vr)",
        f"cr as (select held, t, {S.confusion('y', 'case when w >= t then 1 - d1 else d1 end')} from vr join hr on fold <> held, gr group by all)",
        f"br as (select held as fold, arg_max(t, struct_pack(m := round({S.mcc()}, 12), t := t)) as t from cr group by held)",
        "ar as (select y, d1, case when w >= t then 1 - d1 else d1 end as pred from vr join br using (fold))",
        f"a1 as (select count(*) filter (where pred <> d1) as n_flipped, {S.confusion()} from ar)", f"a0 as (select {S.confusion('y', 'd1')} from ar)", f"f0 as (select round({S.mcc()}, 9) as mcc_first from a0)",
    )
    + f"select n_flipped, round({S.mcc()}, 9) as mcc, mcc_first from a1, f0",
)
def two_stage_corrector(spark: SparkSession, d: str) -> DataFrame:
    """A second model for where the first is wrong; flips above a threshold that the other folds chose.

    Rows are counted by fold and the thresholds they reach, so the choice works on a small table.
    """
    b = rows(spark, d)
    first = M.logistic_oof(b).select("item_id", F.col("score").alias("p1"))
    j = cut(b.join(first, "item_id"), "first").withColumn("d1", (F.col("p1") >= 0.5).cast("int"))
    wrong = M.logistic_oof(j.withColumn("y", (F.col("d1") != F.col("y")).cast("int")), c=0.03).select("item_id", F.round("score", 9).alias("w"))
    v = cut(j.join(wrong, "item_id").select("item_id", "fold", "y", "d1", "w"), "second")
    grid = F.array(*[F.lit(t) for t in _FLIPS])
    cells = v.groupBy("fold", "y", "d1", F.size(F.filter(grid, lambda t: t <= F.col("w"))).alias("reach")).agg(F.count(F.lit(1)).alias("n"))
    held = cells.select(F.col("fold").alias("held")).distinct()
    t = cells.join(F.broadcast(held), F.col("fold") != F.col("held")).select("*", F.posexplode(grid).alias("k", "t"))  # a row per fold; cells are few
    pred = F.when(F.col("reach") > F.col("k"), 1 - F.col("d1")).otherwise(F.col("d1"))
    of = lambda y, p: F.sum(F.when((F.col("y") == y) & (pred == p), F.col("n")).otherwise(0))
    best = t.groupBy("held", "t").agg(of(1, 1).alias("tp"), of(0, 1).alias("fp"), of(1, 0).alias("fn"), of(0, 0).alias("tn"))
    best = best.groupBy(F.col("held").alias("fold")).agg(F.max_by("t", F.struct(F.round(X.mcc(), 12), F.col("t"))).alias("t"))
    a = v.join(F.broadcast(best), "fold").withColumn("pred", F.when(F.col("w") >= F.col("t"), 1 - F.col("d1")).otherwise(F.col("d1")))
    two = a.agg(*X.confusion(), X.count_if(F.col("pred") != F.col("d1")).alias("n_flipped"))
    base = a.agg(*X.confusion("y", "d1")).select(out(X.mcc()).alias("mcc_first"))
    return two.select("n_flipped", out(X.mcc()).alias("mcc")).join(F.broadcast(base))  # one row each


@q("moe_experts")
def moe_experts(spark: SparkSession, d: str) -> DataFrame:
    """An expert per data set: each item by its own data set's, all by vote, mean, maximum and a learned gate, beside one model for all."""
    r = rows(spark, d)
    names = sorted(x[0] for x in r.select("dataset").distinct().collect())  # data sets are few
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("dataset")) - 1
    r = r.withColumn("x", F.concat("x", F.array(number.cast("double"))))
    return quality(M.sampled_oof(r, {k: M.experts(k, len(names)) for k in ("pooled", "own", "hard", "soft", "max", "gated")}))


@q("component_importance")
def component_importance(spark: SparkSession, d: str) -> DataFrame:
    """Principal components of the training parts: their weight in the probe, AUROC alone, share of variance, and likeness from fold to fold."""

    def work(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        m, s, p = M._pca(x, 8)
        z = (x - m) / s @ p.T
        w = M.fit_logistic(z, y)[1]["w"][:-1]  # on standardised components: |coefficient| times deviation
        return [np.abs(w), np.array([M.auroc(z[:, k], y) for k in range(z.shape[1])]), z.var(axis=0) / ((x - m) / s).var(axis=0).sum(), p]

    got = [v for _, v in sorted(M.sampled(rows(spark, d), work).items())]
    if not got:
        return spark.createDataFrame([], "component int, importance double, auroc double, variance double, likeness double")
    mean = lambda k: np.mean([g[k] for g in got], axis=0)
    like = np.mean([np.abs((a[3] * b[3]).sum(axis=1)) for a, b in zip(got, got[1:], strict=False)], axis=0) if len(got) > 1 else np.full(len(got[0][0]), np.nan)
    strength = np.abs(mean(1) - 0.5) + 0.5
    data = [(k + 1, *(round(float(c[k]), 6) for c in (mean(0), strength, mean(2), like))) for k in range(len(got[0][0]))]
    return spark.createDataFrame(data, "component int, importance double, auroc double, variance double, likeness double")


@q(
    "referee_fit",
    sql=_recursive(
        SQL_FOLDED, "pw as (select item_id, fold, y as truth, cast(saplma >= 0 as int) as pa, cast(lapeigvals >= 0 as int) as pb, [saplma, lapeigvals, abs(saplma), abs(lapeigvals), saplma - lapeigvals] as x from wf)",
        "xr as materialized (select item_id, fold, cast(pa = truth as int) as y, x from pw where (pa = truth) <> (pb = truth))", S.logistic("xr", 5),
        "ro as (select 'one' as one, * from lo)", S.auroc("ro", "one"),
        "jo as (select pw.truth as y, score, unnest([{'who': 'pa', 'pred': pa}, {'who': 'pb', 'pred': pb}, {'who': 'routed', 'pred': case when score < 0.5e0 then pb else pa end}, {'who': 'best', 'pred': case when pa = truth or pb = truth then truth else 1 - truth end}], recursive := true) from pw left join lo using (item_id))",
        f"cw as (select who, count(score) as n, {S.confusion()} from jo group by all)", f"mw as (select who, n, {S.mcc()} as m from cw)",
    )
    + "select max(n) as n_routable, round(max(m) filter (where who = 'routed'), 9) as routed_mcc, round(max(m) filter (where who = 'pa'), 9) as first_mcc, round(max(m) filter (where who = 'pb'), 9) as second_mcc, round(max(m) filter (where who = 'best'), 9) as oracle_mcc, round(max(auroc), 9) as referee_auroc from mw, roc",
)
def referee_fit(spark: SparkSession, d: str) -> DataFrame:
    """A model of which of two methods is right, fitted where exactly one is; it routes those items, the first method keeps the rest."""
    w = folded(spark, d)
    pa, pb = ((F.col(m) >= 0).cast("int") for m in ("saplma", "lapeigvals"))
    j = cut(w.select("item_id", "fold", F.col("y").alias("truth"), pa.alias("pa"), pb.alias("pb"), F.array("saplma", "lapeigvals", F.abs("saplma"), F.abs("lapeigvals"), F.col("saplma") - F.col("lapeigvals")).alias("x")), "pairs")
    one = j.filter("(pa = truth) <> (pb = truth)").withColumn("y", (F.col("pa") == F.col("truth")).cast("int"))
    oof = cut(M.logistic_oof(one), "referee")
    a = R.auroc(oof.withColumn("one", F.lit(1)), ["one"]).select(out("auroc").alias("referee_auroc"))
    r = j.join(oof.select("item_id", "score"), "item_id", "left").withColumn("y", F.col("truth"))
    r = r.withColumn("routed", F.when(F.col("score") < 0.5, F.col("pb")).otherwise(F.col("pa"))).withColumn("best", F.when((F.col("pa") == F.col("y")) | (F.col("pb") == F.col("y")), F.col("y")).otherwise(1 - F.col("y")))
    r = r.unpivot(["item_id", "y", "score"], ["pa", "pb", "routed", "best"], "who", "pred").groupBy("who").agg(*X.confusion(), F.count("score").alias("n")).select("who", "n", X.mcc().alias("m"))
    of = lambda k: out(F.max(F.when(F.col("who") == k, F.col("m"))))
    return r.agg(F.max("n").alias("n_routable"), of("routed").alias("routed_mcc"), of("pa").alias("first_mcc"), of("pb").alias("second_mcc"), of("best").alias("oracle_mcc")).join(F.broadcast(a))  # one row each


@q("separability")
def separability(spark: SparkSession, d: str) -> DataFrame:
    """How well true and false positives, true and false negatives, and rescued and lost errors of the anchor can be told apart: by its score alone and by a probe on the block."""
    r = rows(spark, d).join(V.wide(spark, d).select("item_id", "saplma", "icr"), "item_id")
    r = cut(r.withColumn("pa", (F.col("saplma") >= 0).cast("int")).withColumn("pb", (F.col("icr") >= 0).cast("int")), "decided")
    parts = {"positives": (r.filter("pa = 1"), F.col("y")), "negatives": (r.filter("pa = 0"), F.col("y")), "errors": (r.filter("pa <> y"), (F.col("pb") == F.col("y")).cast("int"))}
    out_ = None
    for name, (p, label) in parts.items():
        p = cut(p.withColumn("y", label).withColumn("method", F.lit("score")), name)
        own = p.select("method", "y", F.col("saplma").alias("score")).unionByName(M.sampled_oof(p, {"logistic": lambda x, y, v: M.fit_logistic(x, y), "radial": lambda x, y, v: M.fit_radial(x, y)}).select("method", "y", "score"))
        a = R.auroc(own, ["method"]).select(F.lit(name).alias("population"), "method", "n_pos", "n_neg", out("auroc").alias("auroc"))
        out_ = a if out_ is None else out_.unionByName(a)
    return out_


@q("gnn_fit")
def gnn_fit(spark: SparkSession, d: str) -> DataFrame:
    """A message-passing network trained end to end for each fold, on at most BOUND graphs; every graph is scored."""
    nodes = node_features(spark, d).select("item_id", F.struct("i", F.concat("attn", "act").alias("x")).alias("n")).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list("n")), lambda n: n["x"]).alias("nodes"))  # a graph's tokens
    e = edges(spark, d).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", "head", "a"))).alias("edges"))
    label = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / V.TOKENS).alias("item_id")).agg(F.avg((F.col("label") < 3).cast("int")).alias("r")).select("item_id", (F.col("r") >= 0.3).cast("int").alias("y"))
    g = nodes.join(e, "item_id", "left").join(label, "item_id")
    g = g.join(G.group_folds(label.withColumn("group_id", F.col("item_id").cast("string")).withColumn("dataset", F.lit("graph")), FOLDS, "graphs"), F.col("item_id").cast("string") == F.col("group_id")).drop("group_id")
    g = cut(g.select("item_id", "fold", "y", "nodes", "edges"), "graphs")
    folds = [r[0] for r in g.select("fold").distinct().orderBy("fold").collect()]
    parts = None
    for held in folds:
        p = g.filter(F.col("fold") != held).orderBy(order_hash(F.lit("fit"), F.col("item_id").cast("string")), "item_id").limit(M.BOUND).withColumn("held", F.lit(held))
        parts = p if parts is None else parts.unionByName(p)

    def packed(pdf: pd.DataFrame) -> graphnet.Graphs:
        es = [[(r["i"], r["j"], r["head"], r["a"]) for r in e] if e is not None else [] for e in pdf["edges"]]
        return graphnet.pack([np.array([np.asarray(v, float) for v in n]) for n in pdf["nodes"]], es, PROMPT, V.HEADS)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id")
        p = graphnet.fit(packed(pdf), pdf["y"].to_numpy(float), pdf["item_id"].to_numpy() % 4 == 0)
        return pd.DataFrame({"held": [int(pdf["held"].iloc[0])], "model": [pickle.dumps(p)]})

    models = {r["held"]: pickle.loads(r["model"]) for r in parts.groupBy("held").applyInPandas(train, "held int, model binary").collect()} if parts is not None else {}  # a model per fold

    def score(parts):  # noqa: ANN001, ANN202
        for pdf in parts:
            for fold, own in pdf.groupby("fold"):
                s = graphnet.scores(models[fold], packed(own))
                yield pd.DataFrame({"item_id": own["item_id"], "fold": own["fold"], "y": own["y"], "score": s.round(6), "pred": (s >= models[fold]["threshold"]).astype(int)})

    return g.mapInPandas(score, "item_id long, fold int, y int, score double, pred int")
