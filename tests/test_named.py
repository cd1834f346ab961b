import pytest

from tallymill.functions import named


def test_rule_judges(spark):
    named.install(spark)
    golds = ["The Indian Ocean", "Indian Ocean"]
    rows = [("a", "the indian ocean!", golds), ("b", "It is the Indian Ocean, I think", golds), ("c", "Atlantic", golds), ("d", " ", golds), ("e", "I don't know.", golds), ("f", "x", []), ("g", "x", None), ("h", None, golds), ("i", "ocean indian", golds)]
    df = spark.createDataFrame(rows, "id string, answer string, golds array<string>")
    got = {(r["id"], r["judge"]): r["label"] for r in named.judged(df, "id", "answer", "golds", ["exact", "contains", "overlap"]).collect()}
    assert [got[k, "exact"] for k in "abcdefgh"] == ["NOT_HALLUCINATED", "HALLUCINATED", "HALLUCINATED", "INVALID", "INVALID", "UNPARSEABLE", "UNPARSEABLE", "INVALID"]
    assert got["b", "contains"] == "NOT_HALLUCINATED" and got["i", "contains"] == "HALLUCINATED" and got["i", "overlap"] == "NOT_HALLUCINATED"
    assert set(got.values()) <= set(named.LABELS)


def test_extractors_and_entries_of_a_user(spark):
    names = named.install(spark, features={"half": named.Entry("x ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(x, v -> v / 2)")})
    assert "feature_half" in names and "judge_exact" in names
    df = spark.createDataFrame([("i", [3.0, 4.0]), ("k", None), ("l", [])], "id string, x array<float>")
    got = {(r["id"], r["block"]): r["values"] for r in named.extracted(df, "id", "x", ["norm", "top", "half", "moments"]).collect()}
    assert got == {("i", "norm"): [5.0], ("i", "top"): [4.0, 3.0], ("i", "half"): [1.5, 2.0], ("i", "moments"): [3.5, 12.5, 3.0, 4.0]}
    assert spark.sql("select feature_norm(array(3D, 4D))").first()[0] == [5.0]
    with pytest.raises(ValueError):
        named.install(spark, features={"norm": named.Entry("x ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "x")})
    with pytest.raises(ValueError):
        named.install(spark, judges={"no; drop": named.Entry("a STRING", "STRING", "a")})


def test_sources(spark, small):
    items = spark.read.parquet(f"{small}/items.parquet")
    for name in named.SOURCES:
        got = named.loaded(items, name)
        assert got.columns == ["item_id", "question", "gold_answers", "group_id"] and got.count() > 0
    assert named.loaded(items, "aliases").groupBy("item_id").count().filter("count > 1").count() == 0
    with pytest.raises(KeyError, match="aliases"):
        named.loaded(items, "other")


def test_select_judges(spark):
    v = spark.createDataFrame([("Judge-A",), ("other",), (None,)], "judge string")
    assert named.select_judges(v, "judge-a").count() == 1 and named.select_judges(v).count() == 3
