from collections import Counter

import numpy as np

from tallymill.functions import trees
from tallymill.llm import p8_levels as m

G = "text_id long, text string, lang string, grade string"
D = "doc_id long, text string, lang string"


def test_held_out_accuracy_and_documents_like_the_graded(spark, small, extra):
    graded = spark.read.parquet(f"{small}/graded_texts.parquet")
    grader = m.trained(extra(graded))
    right, n = (sum(v[k] for v in grader.accuracy.values()) for k in (0, 1))
    assert right >= 0.95 * n
    rows = [r for r in graded.collect() if r["grade"]]
    df = spark.createDataFrame([(r["text_id"], r["text"].upper(), "xx") for r in rows], D)
    got = {r["doc_id"]: r["grade"] for r in m.graded(extra(df), grader).collect()}
    assert sum(got[r["text_id"]] == r["grade"] for r in rows) >= 0.95 * len(rows)


def test_short_null_and_odd_texts(spark, small):
    grader = m.trained(spark.read.parquet(f"{small}/graded_texts.parquet"))
    odd = [(1, None, "en"), (2, "", None), (3, "word " * 29, "en"), (4, "word " * 30, None), (5, "คำ " * 40, "und"), (6, "a" * 100000 + " b" * 40, "en"), (7, "1 2 3 " * 20, "de"), (7, "1 2 3 " * 20, "de"), (None, "word " * 50, "en")]
    rows = m.graded(spark.createDataFrame(odd, D), grader).collect()
    assert sorted(r["doc_id"] for r in rows) == [4, 5, 6, 7, 7]
    assert m.graded(spark.createDataFrame([], D), grader).collect() == []


def test_language_is_read_from_the_text():
    assert m.language(Counter("der hund und die katze sind in dem haus".split()), "en") == "de"
    assert m.language(Counter(["xyz"]), "fr-FR") == "fr"
    assert m.language(Counter(["xyz"]), None) == "en"


def test_trees_fit_a_step():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(300, 5))
    y = (x[:, 2] > 0.4) * 2.0 + x[:, 0]
    model = trees.fit(x, y, trees=150)
    assert np.abs(model.predict(x) - y).mean() < 0.1


def test_diversity_looks_at_the_whole_text():
    rng = np.random.default_rng(1)
    for n, width in ((0, 5), (3, 5), (5, 5), (6, 5), (200, 7), (400, 100)):
        w = [f"w{k}" for k in rng.integers(0, 40, n)]
        runs = [len(set(w[a : a + width])) / width for a in range(n - width + 1)] if n > width else [len(set(w)) / max(1, n)]
        assert abs(m.diversity(w, width) - sum(runs) / len(runs)) < 1e-12
    begin = [f"b{k}" for k in range(100)]
    assert m.diversity(begin + ["same"] * 400) < m.diversity(begin + [f"c{k}" for k in range(400)])


def test_accuracy_is_counted_with_cuts_of_other_folds(spark, small, monkeypatch):
    """Cuts that fit their own fold by chance must not show in the figure."""
    seen = []
    real = m._cuts
    monkeypatch.setattr(m, "_cuts", lambda s, y, g: seen.append(len(s)) or real(s, y, g))
    grader = m.trained(spark.read.parquet(f"{small}/graded_texts.parquet"))
    n = sum(v[1] for v in grader.accuracy.values())
    assert seen[0] == n and len(seen) == 1 + m.FOLDS and all(k < n for k in seen[1:]) and sum(n - k for k in seen[1:]) == n
