"""Hand-made cases for what is easily got wrong."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.functions import expressions as X
from tallymill.functions import prompts as T
from tallymill.operators import models as M
from tallymill.operators import paired as P
from tallymill.operators import ranked as R
from tallymill.operators import records
from tallymill.operators import sampling as G
from tallymill.plans.agreement import majority
from tallymill.plans.metrics import held_out_threshold
from tallymill.sources.views import parsed_label


def one(df):
    return df.collect()[0]


def cells(spark, tp, fp, fn, tn):
    return spark.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long")


def test_mcc_is_0_where_undefined_and_does_not_overflow(spark):
    assert one(cells(spark, 5, 3, 0, 0).select(X.mcc().alias("m")))["m"] == 0
    big = 3_000_000_000
    assert one(cells(spark, big, 0, 0, big).select(X.mcc().alias("m")))["m"] == 1
    assert one(cells(spark, 6, 2, 1, 3).select(X.mcc().alias("m")))["m"] == pytest.approx((18 - 2) / math.sqrt(8 * 7 * 5 * 4))


def test_confusion_leaves_out_null_decisions(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (0, 1), (None, 1), (0, 0)], "y int, pred int")
    assert tuple(one(df.agg(*X.confusion()))) == (1, 1, 0, 1)
    assert tuple(one(df.limit(0).agg(*X.confusion()))) == (0, 0, 0, 0)


def test_kappa_is_null_for_one_value(spark):
    k = lambda *n: one(spark.createDataFrame([n], "a long, b long, c long, d long").select(X.kappa("a", "b", "c", "d").alias("k")))["k"]
    assert k(5, 0, 0, 0) is None and k(0, 0, 0, 4) is None
    assert k(2, 0, 0, 2) == 1 and k(0, 2, 2, 0) == -1
    assert k(0, 0, 0, 0) is None


def brute_auroc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auroc_with_ties_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.random() < 0.4), float(rng.integers(0, 30))) for _ in range(500)]
    df = spark.createDataFrame([("a", y, s) for y, s in rows] + [("b", 1, 1.0), ("b", 1, 2.0), ("c", None, 1.0), ("a", 1, None)], "g string, y int, score double")
    got = {r["g"]: r["auroc"] for r in R.auroc(df, ["g"]).collect()}
    assert got["a"] == pytest.approx(brute_auroc(rows)) and got["b"] is None


def test_running_totals_over_pieces(spark):
    rng = np.random.default_rng(1)
    v = np.unique(rng.normal(size=3000))
    w = rng.integers(0, 5, len(v))
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(v, w, strict=True)] + [("h", 1.0, 7)], "g string, v double, w long")
    got = {(r["g"], r["v"]): r["t"] for r in R.running(df, ["g"], "v", {"t": "w"}).collect()}
    below = np.concatenate([[0], np.cumsum(w)[:-1]])
    assert all(got["g", float(a)] == b for a, b in zip(v, below, strict=True)) and got["h", 1.0] == 0


def test_average_ranks(spark):
    df = spark.createDataFrame([("g", x) for x in (3.0, 1.0, 3.0, 2.0, None)], "g string, score double")
    assert {r["score"]: r["avg_rank"] for r in R.average_ranks(df, ["g"]).collect()} == {1.0: 1.0, 2.0: 2.0, 3.0: 3.5}


def test_percentiles_and_kept_rows(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=700), 1)
    df = spark.createDataFrame([("g", float(x), k) for k, x in enumerate(v)] + [("h", 4.0, 0), ("h", None, 1)], "g string, v double, i int")
    shares = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    got = {r["g"]: r["cuts"] for r in R.percentiles(df, ["g"], "v", shares).collect()}
    assert got["g"] == pytest.approx(np.quantile(v, shares).tolist()) and got["h"] == [4.0] * 6
    grid = [0.01, 0.3, 0.301, 0.5, 0.9, 1.0]
    d = df.filter("v is not null").withColumn("y", F.pmod("i", F.lit(3)).cast("int")).withColumn("y", (F.col("y") == 0).cast("int"))
    for largest in (False, True):
        got = {}
        for r in R.kept_at(d.filter("g = 'g'").withColumnRenamed("g", "name"), ["name"], "v", "i", "y", grid, largest).collect():
            got[r["g"]] = (r["m"], r["pos"])
        order = sorted(range(len(v)), key=lambda k: (-v[k] if largest else v[k], k))
        for k, x in enumerate(grid):
            m = max(1, round(x * len(v)))
            assert got[k] == (m, sum(i % 3 == 0 for i in order[:m]))


def test_one_value_for_all_rows_is_cut_where_it_has_to_be(spark):
    df = spark.range(5000).select(F.lit("n").alias("name"), F.lit(0.5).alias("v"), F.format_string("i%05d", "id").alias("i"), (F.col("id") < 1000).cast("int").alias("y"))
    assert [(r["m"], r["pos"]) for r in R.kept_at(df, ["name"], "v", "i", "y", [0.1, 0.4, 1.0]).orderBy("g").collect()] == [(500, 500), (2000, 1000), (5000, 1000)]


def test_held_out_grid_against_brute_force(spark):
    rng = np.random.default_rng(4)
    v, f, y = np.round(rng.normal(size=400), 1), rng.integers(0, 3, 400), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(f, v, y, strict=True)], "fold int, v double, y int")
    grid = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(r["held"], r["k"]): r for r in R.held_out_grid(df, [], "v", {"pos": F.col("y")}, grid).collect()}
    assert len(got) == 15
    for held in range(3):
        own, lab = v[f != held], y[f != held]
        for k, t in enumerate(np.quantile(own, grid)):
            r = got[held, k]
            assert r["t"] == pytest.approx(t) and r["n"] == len(own) and r["total_pos"] == lab.sum()
            assert r["n_below"] == (own < r["t"]).sum() and r["below_pos"] == lab[own < r["t"]].sum()


def test_running_adds_totals_and_the_value_before(spark):
    df = spark.createDataFrame([("g", float(k), k) for k in range(200)] + [("h", 3.0, 1)], "g string, v double, w long")
    rows = R.running(df, ["g"], "v", {"t": "w"}, totals={"all": "w"}, previous="prev").collect()
    assert all(r["prev"] == (r["v"] - 1 if r["v"] else None) and r["all"] == 19900 for r in rows if r["g"] == "g")
    assert [(r["prev"], r["all"], r["t"]) for r in rows if r["g"] == "h"] == [(None, 1, 0)]


def test_numbers_over_pieces(spark):
    rows = [("g", f"k{k:04d}") for k in range(3000)] + [("h", "k0500"), ("h", "a")]
    df = spark.createDataFrame(rows, "g string, key string").repartition(5)
    got = {(r["g"], r["key"]): r["k"] for r in R.numbers(df, ["g"], "key").collect()}
    assert got == {("g", f"k{k:04d}"): k for k in range(3000)} | {("h", "a"): 0, ("h", "k0500"): 1}
    assert sorted(r["k"] for r in R.numbers(df, [], "key").collect()) == list(range(3002))
    assert R.numbers(df.limit(0), ["g"], "key").collect() == []
    h = df.withColumn("h", F.md5("key"))
    turns = {(r["g"], r["key"]): r["t"] for r in G.hash_numbers(h, ["g"], "h", "key", "t").collect()}
    import hashlib

    order = sorted((f"k{k:04d}" for k in range(3000)), key=lambda x: hashlib.md5(x.encode()).hexdigest())
    assert all(turns["g", x] == n for n, x in enumerate(order))


def test_best_threshold_takes_the_lowest_midpoint(spark):
    rows = [("a", 0, 1.0), ("a", 0, 2.0), ("a", 1, 4.0), ("a", 1, 8.0), ("b", 1, 5.0), ("b", 0, 5.0), ("c", 0, 1.0), ("c", 1, 2.0), ("c", 0, 3.0), ("c", 1, 4.0)]
    got = {r["g"]: (r["threshold"], r["mcc"]) for r in R.best_threshold(spark.createDataFrame(rows, "g string, y int, score double"), ["g"]).collect()}
    assert got["a"] == (3.0, 1.0) and got["b"] == (0.5, 0.0)
    assert got["c"][0] == 1.5


def test_held_out_threshold_never_sees_its_fold(spark):
    rows = [("m", f, int(s > 10), float(s)) for f in (0, 1) for s in range(20)]
    got = {r["fold"]: r["threshold"] for r in held_out_threshold(spark.createDataFrame(rows, "method string, fold int, y int, score double"), ["method"]).collect()}
    assert set(got) == {0, 1} and all(10 < t <= 11 for t in got.values())


def test_mcnemar_exact_and_asymptotic(spark):
    df = spark.createDataFrame([(0, 0), (3, 1), (12, 12), (20, 4), (30, 10), (60, 59)], "b long, c long")
    got = {(r["b"], r["c"]): (r["s"], r["p"]) for r in df.select("b", "c", P.mcnemar_statistic(F.col("b"), F.col("c")).alias("s"), P.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()}
    exact = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c))
    assert got[0, 0] == (None, 1.0)
    for k in ((3, 1), (12, 12), (20, 4)):
        assert got[k][0] is None and got[k][1] == pytest.approx(exact(*k))
    for b, c in ((30, 10), (60, 59)):
        s = (abs(b - c) - 1) ** 2 / (b + c)
        assert got[b, c][0] == pytest.approx(s) and got[b, c][1] == pytest.approx(math.erfc(math.sqrt(s / 2)), rel=1e-6)


def test_holm_is_monotone_and_capped(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "n string, p double")
    got = {r["n"]: r["p_adjusted"] for r in P.holm(df, [], "p", ["n"]).collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9})


def test_method_pairs(spark):
    df = spark.createDataFrame([("i", "b", 1), ("i", "a", 0), ("i", "c", 1), ("j", "a", 1)], "item_id string, method string, pred int")
    got = {(r["a"]["method"], r["b"]["method"], r["a"]["pred"]) for r in P.method_pairs(df, ["item_id"], ["pred"]).collect()}
    assert got == {("a", "b", 0), ("a", "c", 0), ("b", "c", 1)}
    assert P.method_pairs(df, ["item_id"], ["pred"], ordered=True).count() == 6


def test_majority_is_strict(spark):
    v = spark.createDataFrame([("a", "j1", "HALLUCINATED"), ("a", "j2", "INVALID"), ("b", "j1", "UNPARSEABLE"), ("b", "j2", "UNPARSEABLE"), ("b", "j3", "INVALID"), ("c", "j1", "NOT_HALLUCINATED")], "item_id string, judge string, label string")
    got = {r["item_id"]: (r["label"], r["scored"], r["unanimous"]) for r in majority(v).collect()}
    assert got == {"a": ("INVALID", False, False), "b": ("UNPARSEABLE", False, False), "c": ("NOT_HALLUCINATED", True, True)}


def test_label_order_matters(spark):
    texts = {" not hallucinated.": "NOT_HALLUCINATED", "Label: HALLUCINATED": "HALLUCINATED", "Not-Hallucinated": "NOT_HALLUCINATED", "it is invalid": "INVALID", "?": "UNPARSEABLE", None: "UNPARSEABLE"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", parsed_label(F.col("t")).alias("x")).collect()} == texts


def test_prompts(spark):
    df = spark.createDataFrame([("Why?", [], " ", ""), ("Why {x}?", [f"g{k}" for k in range(30)], "\u00a0yes\n", "ctx"), (None, None, None, None)], "q string, g array<string>, a string, c string")
    rows = df.select(T.judge_prompt(F.col("q"), F.col("g"), F.col("a")).alias("j"), T.chat_prompt(F.col("q"), F.col("c")).alias("p"), T.few_shot_prompt(F.col("q"), F.col("c")).alias("s")).collect()
    assert "Reference answer(s): (none provided)\n" in rows[0]["j"] and "Model's answer: (empty)\n" in rows[0]["j"] and rows[0]["p"] == "Question: Why?"
    assert "g19\n" in rows[1]["j"] and "g20" not in rows[1]["j"] and "Model's answer: yes\n" in rows[1]["j"] and rows[1]["j"].startswith("Question: Why {x}?\n")
    assert rows[1]["p"] == "Read the passage and answer the final question.\n\nPassage:\nctx\n\nQuestion: Why {x}?"
    assert rows[0]["s"].endswith("A: A lizard\n\nQ: Why?\nA:") and rows[1]["s"].endswith("A: Two\n\nPassage: ctx\nQ: Why {x}?\nA:")
    assert all(v is not None for v in rows[2])
    t = spark.createDataFrame([(" a \n\nb",), ("x\nQ: y",), ("z\nPassage: y",), ("w\nQuestion: y",), (" \t\n",), (None,)], "t string")
    assert [r[0] for r in t.select(T.trim_completion(F.col("t"))).collect()] == ["a", "x", "z", "w\nQuestion: y", "", None]
    item, block = T.split_key(F.col("t"))
    k = spark.createDataFrame([("a/b/c",), ("plain",), ("x/",), (None,)], "t string")
    assert [tuple(r) for r in k.select(item, block).collect()] == [("a/b", "c"), ("", "plain"), ("x", ""), (None, None)]
    assert one(spark.createDataFrame([("__Judge X-1b!",)], "t string").select(T.slug(F.col("t")).alias("s")))["s"] == "judge_x_1b"


def test_last_wins_pending_and_parts(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None), (None, 1, "n")], "id string, seq int, v string")
    assert {(r["id"], r["v"]) for r in records.last_wins(log, ["id"], F.col("seq")).collect()} == {("a", "z"), ("b", None), (None, "n")}
    want = spark.createDataFrame([("a",), ("c",), (None,)], "id string")
    assert {r["id"] for r in records.pending(want, log, "id").collect()} == {"c", None}
    with pytest.raises(LookupError, match="c"):
        records.require_all(want.filter("id is not null"), log, "id")
    parts = [spark.createDataFrame([("k", 1), ("l", 5)], "k string, v int"), spark.createDataFrame([("k", 2)], "k string, v int")]
    assert {(r["k"], r["v"]) for r in records.union_parts(parts, ["k"]).collect()} == {("k", 2), ("l", 5)}


def test_batches_keep_both_budgets(spark):
    df = spark.createDataFrame([("s", k, n) for k, n in enumerate([5, 5, 5, 20, 1, 1, 1, 1])], "g string, k long, n long")
    got = [r["batch"] for r in records.batches(df, "k", "n", "g", 3, 10).orderBy("k").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 3, 4]


def test_jsonl_skips_cut_lines(spark):
    df = spark.createDataFrame([('{"id": "a", "n": 1}',), ('{"id": "b", "n"',), ("",), ('{"other": 1}',)], "value string")
    assert [tuple(r) for r in records.parse_jsonl(df, "id string, n int").filter("id is not null").collect() if r["n"] is not None] == [("a", 1)]


def test_folds_keep_groups_whole_and_draws_are_stable(spark):
    df = spark.createDataFrame([(f"i{k}", "d", f"g{k % 37}", k % 2) for k in range(300)], "item_id string, dataset string, group_id string, y int")
    folds = G.group_folds(df, 5, "s")
    assert folds.count() == folds.select("group_id").distinct().count() == 37
    a, b = (sorted(r["item_id"] for r in G.draw(x, ["dataset"], 20, "seed").collect()) for x in (df, df.repartition(7)))
    assert a == b and len(a) == 20
    assert G.draw(df, ["dataset"], 1000, "seed").count() == 300
    assert G.group_folds(df.limit(0), 5, "s").collect() == []


def test_bootstrap_weights_are_poisson_and_independent(spark):
    g = spark.range(400).select(G.group_number(F.lit("x"), F.col("id").cast("string")).alias("g"))
    w = g.crossJoin(spark.range(1000).withColumnRenamed("id", "r")).select("g", "r", G.bootstrap_weight(F.col("g"), F.col("r")).alias("w")).toPandas()
    share = w["w"].value_counts(normalize=True)
    for k, p in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert abs(share[k] - p) < 0.01
    per = w.groupby("r")["w"].sum()  # the number of groups drawn varies as a sum of independent ones would
    assert abs(per.mean() - 400) < 4 and 14 < per.std() < 27


def test_hypergeometric_quantiles():
    for total, marked, drawn in ((50, 13, 20), (9, 9, 4), (9, 0, 4), (1000, 400, 1), (30, 20, 25)):
        p = np.array([math.comb(marked, k) * math.comb(total - marked, drawn - k) if drawn - k <= total - marked else 0 for k in range(min(marked, drawn) + 1)], float)
        cum = np.cumsum(p / p.sum())
        for u in (0.0001, 0.2, 0.5, 0.83, 0.9999):
            assert G.hypergeometric(u, total, marked, drawn) == int((cum < u).sum())
    assert abs(G.hypergeometric(0.5, 10**9, 4 * 10**8, 10**6) - 400_000) < 5


def test_nested_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(f"i{k}", "d", f"g{k % 41}", k % 2) for k in range(400)], "item_id string, dataset string, group_id string, y int")
    rows = G.nested_groups(df, 5, 4, "s", "inner").collect()
    assert len(rows) == 5 * 41
    for held in range(5):
        n = {x: sum(r["held"] == held and r["role"] == x for r in rows) for x in ("test", "validation", "train")}
        assert n["test"] in (8, 9, 10) and n["validation"] in range(7, 11) and sum(n.values()) == 41
    assert all(sum(r["group_id"] == g and r["role"] == "test" for r in rows) == 1 for g in {r["group_id"] for r in rows})


def test_logistic_regression_is_the_penalised_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) * [1, 5, 0.1, 2] + 3
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=200) > 4.5).astype(int)
    df = spark.createDataFrame([(k, k % 4, int(y[k]) if k else None, x[k].tolist()) for k in range(200)], "item_id long, fold int, y int, x array<double>")
    got = {r["item_id"]: r["score"] for r in M.logistic_oof(df, c=0.3).collect()}
    assert len(got) == 200
    for held in range(4):
        rows = [k for k in range(1, 200) if k % 4 != held]
        p = M.fit_logistic(x[rows], y[rows].astype(float), 0.3)[1]
        test = [k for k in range(200) if k % 4 == held]
        assert np.allclose([got[k] for k in test], M.PREDICT["logistic"](p, x[test]), atol=1e-8)


def logistic_rows(spark, d=4, n=200, parts=4):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, d)) + 1
    y = (x[:, 0] - x[:, 1] + rng.normal(size=n) > 0).astype(int)
    return spark.createDataFrame([(k, k % 4, int(y[k]), x[k].tolist()) for k in range(n)], "item_id long, fold int, y int, x array<double>").repartition(parts)


def test_wide_blocks_reach_the_same_optimum(spark, monkeypatch):
    df = logistic_rows(spark)
    want = {r["item_id"]: r["score"] for r in M.logistic_oof(df).collect()}
    monkeypatch.setattr(M, "WIDE", 3)
    got = {r["item_id"]: r["score"] for r in M.logistic_oof(df).collect()}
    assert max(abs(want[k] - got[k]) for k in want) < 1e-5


def test_the_driver_sees_a_row_per_fold_whatever_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "BRANCH", 3)
    work = lambda x, y, held: np.array([len(x), y.sum()])
    seen = []
    for parts in (1, 2, 9, 20):
        rows = M.added(logistic_rows(spark, parts=parts), work, [0, 1, 2, 3]).collect()
        assert len(rows) == 4
        seen.append({r["fold"]: np.frombuffer(r["s"], float).tolist() for r in rows})
    assert all(s == seen[0] for s in seen) and seen[0][0][0] == 150


def rule(n=600):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(n, 3))
    x = z @ rng.normal(size=(3, 20)) + 0.3 * rng.normal(size=(n, 20))
    return x, (z[:, 0] - z[:, 1] + 0.2 * rng.normal(size=n) > 0).astype(float)


@pytest.mark.parametrize("fit", [M.fit_tuned, M.fit_pca, M.fit_block_pca, M.fit_lda, M.fit_svm, M.fit_radial, M.fit_fourier, M.fit_nystroem, M.fit_mlp, M.fit_boosted, lambda x, y: M.fit_mlp(x, y, (16, 8), blocks=[0, 8, 20])])
def test_fits_learn_a_plain_rule(fit):
    x, y = rule()
    name, p = fit(x[:400], y[:400])
    assert M.auroc(M.predict(name, p, x[400:]), y[400:]) > 0.85


def test_block_encoders_see_their_own_block_only():
    x, y = rule(300)
    w = M.fit_mlp(x, y, (6, 4), epochs=5, blocks=[0, 8, 20])[1]["ws"][0]
    assert (w[:8, 3:] == 0).all() and (w[8:, :3] == 0).all() and (w[:8, :3] != 0).any()


@pytest.mark.parametrize("fit", [M.layer_mix(5, 1), M.layer_mix(5, 2), M.last_layers(5, 2, "per_layer"), M.last_layers(5, 3, "joint"), M.nested(M.fit_logistic, [{"c": c} for c in M.C_GRID])])
def test_nested_fits_choose_on_the_validating_rows(fit):
    x, y = rule()
    v = np.arange(400) % 4 == 0
    name, p = fit(x[:400], y[:400], v)
    s = M.predict(name, p, x[400:])
    assert M.auroc(s, y[400:]) > 0.8 and ((s >= p["threshold"]) == (y[400:] > 0)).mean() > 0.7


def test_experts_and_gate():
    rng = np.random.default_rng(1)
    tag = rng.integers(0, 2, 800)
    x = rng.normal(size=(800, 4))
    x[:, 3] = 4 * tag + rng.normal(size=800) * 0.3  # the gate can see the data set
    y = (np.where(tag == 0, x[:, 0], -x[:, 0]) > 0).astype(float)  # the rule turns over between data sets
    z, v = np.hstack([x, tag[:, None]]), np.arange(600) % 4 == 0
    a = {k: M.auroc(M.predict(*M.experts(k, 2)(z[:600], y[:600], v), z[600:]), y[600:]) for k in ("pooled", "own", "gated", "soft", "hard", "max")}
    assert a["own"] > 0.95 and a["gated"] > 0.95 and a["pooled"] < 0.7
    few = M.experts("own", 3)(z[:600], y[:600], v)[1]
    assert set(few["experts"]) == {0, 1}


def test_cutoff_is_the_lowest_best_midpoint():
    assert M.cutoff(np.array([1.0, 2, 4, 8]), np.array([0, 0, 1, 1])) == 3.0
    assert M.cutoff(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1])) == 1.5
    assert M.cutoff(np.array([5.0, 5]), np.array([0, 1])) == 0.5


def test_graph_network_gradients_and_learning():
    from tallymill.functions import graphnet as N

    rng = np.random.default_rng(0)
    nodes = [rng.normal(size=(rng.integers(3, 7), 4)) for _ in range(12)] + [rng.normal(size=(1, 4))]
    edges = [[(i, j, int(rng.integers(2)), float(rng.uniform(0.1, 1))) for i in range(len(x)) for j in range(i)] for x in nodes]
    g = N.pack(nodes, edges, 2, 2)
    par = N.start(rng, 4, 2, 5, 2)
    s, kept = N.forward(par, g, 2)
    grad = N.backward(par, g, kept, np.ones(len(nodes)), 2)
    assert set(grad) == set(par)
    for k, x in par.items():
        at = tuple(rng.integers(n) for n in x.shape)
        moved = {**par, k: x.copy()}
        moved[k][at] += 1e-6
        assert (N.forward(moved, g, 2)[0].sum() - s.sum()) / 1e-6 == pytest.approx(grad[k][at], abs=1e-4)
    # A rule that only messages carry: the label is in a token of the prompt, the reading over the response.
    y = rng.integers(0, 2, 300).astype(float)
    nodes = [np.vstack([[2 * t - 1, 0.0], rng.normal(size=(3, 2)) * 0.1]) for t in y]
    edges = [[(i, 0, 0, 1.0) for i in range(1, 4)] for _ in y]
    g = N.pack(nodes, edges, 1, 1)
    p = N.fit(g.take(np.arange(200)), y[:200], np.arange(200) % 4 == 0, hidden=8)
    assert M.auroc(N.scores(p, g.take(np.arange(200, 300))), y[200:]) > 0.95


def test_sampled_fits_score_every_row(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    df = spark.createDataFrame([(k, k % 3, int(x[k, 0] > 0), x[k].tolist()) for k in range(120)], "item_id long, fold int, y int, x array<double>")
    rows = M.sampled_oof(df, M.fit_logistic, bound=30).collect()
    assert len(rows) == 120 and all(r["score"] is not None for r in rows)
    both = M.sampled_oof(df, {"a": M.nested(M.fit_logistic, [{"c": 1.0}]), "b": lambda x, y, v: M.fit_lda(x, y)}).collect()
    assert len(both) == 240 and {r["method"] for r in both} == {"a", "b"} and {r["pred"] for r in both} == {0, 1}
    assert M.sampled_oof(df.limit(0), M.fit_logistic).collect() == []


def test_vectors_are_usable_in_every_element(spark):
    from tallymill.plans.features import usable

    good = [float(k) for k in range(64)]
    rows = [("a", good), ("b", [*good[:-1], float("nan")]), ("c", [*good[:-1], None]), ("d", [*good[:-1], float("inf")]), ("e", good[:-1]), ("f", None)]
    assert [r["k"] for r in usable(spark.createDataFrame(rows, "k string, hidden_states array<float>")).collect()] == ["a"]


def test_every_column_is_standardized(spark, small):
    from tallymill.plans import load

    z = load().queries["standardize"](spark, small).groupBy("dim").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("sd")).collect()
    assert sorted(r["dim"] for r in z) == list(range(64))
    assert all(abs(r["m"]) < 1e-4 and abs(r["sd"] - 1) < 1e-4 for r in z)


def test_bootstrap_covers_every_pair_of_methods(spark, small):
    from tallymill.plans import load

    rows = load().queries["bootstrap_ci"](spark, small).collect()
    assert len({(r["method_a"], r["method_b"]) for r in rows}) > 1
    assert all(r["method_a"] < r["method_b"] and r["low"] <= r["difference"] <= r["high"] and r["n_seeds"] >= 1 for r in rows)


def test_permutations_agree_with_dealing_rows(spark):
    """Counts drawn by cluster have the distribution of marks dealt to rows."""
    rng = np.random.default_rng(0)
    sizes, marked = [30, 25, 45], 40
    drawn = []
    for u in rng.uniform(size=(4000, 3)):
        left, marks, own = sum(sizes), marked, []
        for x, n in zip(u, sizes, strict=True):
            own.append(G.hypergeometric(float(x), left, marks, n))
            left, marks = left - n, marks - own[-1]
        drawn.append(own)
    cluster = np.repeat([0, 1, 2], sizes)
    dealt = np.array([np.bincount(cluster[rng.permutation(100)[:marked]], minlength=3) for _ in range(4000)])
    assert np.allclose(np.mean(drawn, axis=0), dealt.mean(axis=0), atol=0.15) and np.allclose(np.std(drawn, axis=0), dealt.std(axis=0), atol=0.12)
    assert all(sum(x) == marked for x in drawn)


def test_nearest_labels_against_brute_force(spark):
    from tallymill.plans.features import nearest_labels

    rng = np.random.default_rng(6)
    x, label = rng.integers(0, 3, size=(90, 3)).astype(float), rng.integers(0, 3, 90)
    df = spark.createDataFrame([(k, int(label[k]), x[k].tolist()) for k in range(90)], "item_id long, label long, x array<double>").repartition(5)
    got = {r["item_id"]: r["purity"] for r in nearest_labels(df, df.filter("item_id % 20 = 0"), 4).collect()}
    for k in range(0, 90, 20):
        near = sorted((float(((x[k] - x[j]) ** 2).sum()), j) for j in range(90) if j != k)[:4]
        assert got[k] == pytest.approx(sum(label[j] == label[k] for _, j in near) / 4)


def test_a_panel_has_to_be_complete(spark):
    from tallymill.plans.agreement import complete, panel

    v = spark.createDataFrame([("i", "a", "X"), ("i", "b", "X"), ("j", "a", "X"), ("j", "c", "X"), ("k", "a", "X"), ("k", "b", "Y"), ("k", "c", "Y")], "item_id string, judge string, label string")
    assert {r[0] for r in panel(v, 2).collect()} == {"a", "b"}
    assert {r["item_id"] for r in complete(v, panel(v, 2)).collect()} == {"i", "k"}
    assert {r["item_id"] for r in complete(v, spark.createDataFrame([("a",), ("none",)], "judge string")).collect()} == set()


def test_cut_tables_are_removed_and_a_cluster_needs_a_shared_folder(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from tallymill import session

    a = session.cut(spark.range(3), "a")
    where = lambda t: Path(t._tallymill_path.removeprefix("file://"))
    path = where(a)
    assert path.exists() and a.count() == 3
    b = session.cut(a, "b", replaces=a)
    assert not path.exists() and b.count() == 3
    session.remove(b)
    session.remove(spark.range(1))  # no table: nothing happens
    assert not where(b).exists()

    class Context:
        applicationId, master = "other", "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
