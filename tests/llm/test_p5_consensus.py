import datetime as dt
import random

import numpy as np
import pytest

from tallymill.llm import p5_consensus as m

V = "verdict_id long, item_id string, judge string, label string, judged_at timestamp"
T = dt.datetime(2025, 1, 1)


def planted(seed=0, items=300):
    rng = random.Random(seed)
    good, bad = [f"judge-good-{k}" for k in range(4)], ["judge-flip-1", "judge-flip-2", "judge-always"]
    rows, truth, n = [], {}, 0
    for k in range(items):
        t = rng.choice(m.LABELS)
        truth[f"i{k}"] = t
        for j in [*rng.sample(good, 2), *bad]:
            if "always" in j:
                label = "NOT_HALLUCINATED"
            elif "flip" in j:
                label = rng.choice([x for x in m.LABELS if x != t])
            else:
                label = t if rng.random() < 0.95 else rng.choice(m.LABELS)
            n += 1
            rows.append((n, f"i{k}", j, label, T))
    return rows, truth


def test_reliability_beats_the_majority(spark, extra):
    rows, truth = planted()
    items, model = m.consensus(extra(spark.createDataFrame(rows, V)))
    got = {r["item_id"]: r["label"] for r in items.collect()}
    assert sum(got[i] == t for i, t in truth.items()) > 0.93 * len(truth)
    right = {r["judge"]: r["p"] for r in model.filter("truth = given and truth = 'HALLUCINATED'").collect()}
    assert min(right[j] for j in right if "good" in j) > 0.8 > 0.3 > max(right[j] for j in right if "flip" in j)


def test_joins_give_the_same_model(spark):
    rows, _ = planted(1, 80)
    votes = m.cut(m.counting(spark.createDataFrame(rows, V)))
    a, model_a = m.consensus(spark.createDataFrame(rows, V))
    b, model_b = m._consensus_by_joins(votes)
    assert {(r["item_id"], r["label"], r["n_votes"], r["differ"]) for r in a.collect()} == {(r["item_id"], r["label"], r["n_votes"], r["differ"]) for r in b.collect()}
    pa, pb = ({(r["judge"], r["truth"], r["given"]): r["p"] for r in x.collect()} for x in (model_a, model_b))
    assert pa.keys() == pb.keys() and max(abs(pa[k] - pb[k]) for k in pa) < 1e-4


def test_newest_label_and_spelling(spark):
    later = T + dt.timedelta(hours=1)
    rows = [(1, "a", "Judge-X", "HALLUCINATED", T), (2, "a", "judge_x ", "**NOT_HALLUCINATED**", later), (3, "a", "judge-y", "Label: HALLUCINATED", T), (3, "a", "judge-y", "Label: HALLUCINATED", T), (4, "a", "judge-z", None, later), (5, "a", "judge-w", "UNPARSEABLE", later), (6, None, "judge-w", "INVALID", T), (7, "b", None, "INVALID", T), (8, "c", "judge-x", "Invalid.", None), (9, "c", "judge-x", "not hallucinated", T)]
    got = sorted(tuple(r) for r in m.counting(spark.createDataFrame(rows, V)).collect())
    assert got == [("a", "judgex", "NOT_HALLUCINATED"), ("a", "judgey", "HALLUCINATED"), ("c", "judgex", "NOT_HALLUCINATED")]


def test_empty(spark):
    items, model = m.consensus(spark.createDataFrame([], V))
    assert items.collect() == [] and model.collect() == []


def test_posterior_is_bayes():
    conf = np.array([[[0.8, 0.1, 0.1], [0.2, 0.6, 0.2], [0.1, 0.1, 0.8]]])
    p = m.posterior(np.array([0, 0]), np.array([0, 1]), np.array([0, 2]), (np.log(conf), np.log(np.full(3, 1 / 3))))
    want = np.array([0.8 * 0.1, 0.2 * 0.6, 0.1 * 0.1])
    assert p[0] == pytest.approx(want / want.sum())
