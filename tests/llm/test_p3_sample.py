from collections import Counter

from tallymill.llm import p3_sample as m

P = "item_id string, dataset string, y int"
T = "dataset string, y int, target_share double, min_rows int"


def test_shares_minimum_and_shortage(spark, extra):
    rows = [(f"a{k}", ("Set-A", "set_a", " SETA ")[k % 3], 0) for k in range(700)] + [(f"b{k}", "set b", 1) for k in range(297)] + [("c1", "c", 1), ("c1", "C", 1), ("d", "c", -1), ("e", "c", None), (None, "c", 1), ("g", None, 1), ("c2", "c", 1), ("c3", "c", 0)]
    targets = spark.createDataFrame([("set_a", 0, 0.5, 1), ("set_b", 1, 0.4, 1), ("c", 1, 0.01, 5), ("c", 0, 0.0, 0), ("gone", 1, 0.0, 2), ("none", 0, None, None)], T)
    items = m.scored(extra(spark.createDataFrame(rows * 2, P)))
    need = {(r["dataset"], r["y"]): r for r in m.needs(items, targets).collect()}
    assert need["set_a", 0]["wanted"] == 50 and need["c", 1]["available"] == 2
    assert {k for k, r in need.items() if r["short"]} == {("c", 1), ("gone", 1)}
    drawn = [tuple(r) for r in m.reservoirs(items, m.needs(items, targets), "quota").collect()]
    assert len(drawn) == len(set(drawn))
    assert Counter((d, y) for d, y, _ in drawn) == {("set_a", 0): 54, ("set_b", 1): 44, ("c", 1): 2}  # 98 rows in the proportion of 5 to 4


def test_a_share_is_a_decimal(spark):
    items = m.scored(spark.createDataFrame([(f"i{k}", "a" if k < 7 else "b", 0) for k in range(1000)], P))
    need = m.needs(items, spark.createDataFrame([("a", 0, 0.07, 0)], T)).collect()[0]
    assert need["wanted"] == 7 and not need["short"]


def test_empty(spark):
    items = m.scored(spark.createDataFrame([], P))
    targets = spark.createDataFrame([("a", 0, 0.5, 3), ("b", 1, 0.5, 0)], T)
    assert [(r["dataset"], r["short"]) for r in m.needs(items, targets).orderBy("dataset").collect()] == [("a", True), ("b", False)]
    assert m.reservoirs(items, m.needs(items, targets)).collect() == []


def test_found_comes_from_the_sample(spark, small):
    short = {(r["dataset"], r["y"]) for r in m.p3_report(spark, small).collect() if r["short"]}
    assert {tuple(r) for r in m.p3_found(spark, small).collect()} == short


def test_feasible_quotas():
    assert m.feasible([(1000, 0, 0.5), (1000, 0, 0.3), (1000, 0, 0.2)], 100) == [50, 30, 20]
    assert m.feasible([(10, 0, 0.5), (1000, 0, 0.3), (1000, 0, 0.2)], 100) == [10, 54, 36]  # what is missing goes to the others
    assert m.feasible([(1000, 60, 0.1), (1000, 0, 0.6), (1000, 0, 0.3)], 150) == [60, 60, 30]  # a minimum takes from the others
    assert m.feasible([(5, 0, 0.5), (7, 9, 0.5)], 100) == [5, 7] and m.feasible([], 3) == []
    assert m.feasible([(100, 0, 1.0), (100, 0, 1.0), (100, 0, 1.0)], 100) == [34, 33, 33]
    assert m.feasible([(50, 40, 0.0), (50, 40, 0.5)], 10) == [40, 40]  # minima come before the size


def test_reservoirs_merge(spark):
    """Whatever the partitions, a reservoir is the items of least priority."""
    import hashlib

    rows = [(f"i{k}", "a", k % 2) for k in range(3000)]
    items = m.scored(spark.createDataFrame(rows, P).repartition(7))
    targets = spark.createDataFrame([("a", 0, 0.5, 611), ("a", 1, 0.5, 2)], T)
    got = {(r["y"], r["item_id"]) for r in m.reservoirs(items, m.needs(items, targets)).collect()}
    for y, n in ((0, 611), (1, 150)):
        own = sorted((i for i, _, z in rows if z == y), key=lambda i: hashlib.md5(f"sample:{i}".encode()).hexdigest())[:n]
        assert {i for z, i in got if z == y} == set(own)
