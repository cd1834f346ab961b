import random

import pytest

from tallymill.llm import p1_splits as m
from tallymill.llm.flow import Network
from tallymill.llm.graphs import components

ITEMS = "item_id string, group_id string"
PLAN = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def run(spark, rows, extra=lambda x: x):
    items = extra(spark.createDataFrame(rows, ITEMS))
    return m.assign(items, spark.createDataFrame(PLAN, "split string, share double")).collect()


def test_spellings_name_one_group(spark):
    same = ["squad_v2:0c08", "SQUAD_V2/0C08", "squad_v2 : 0c08", "squad_v2::0c08 ", "squad_v２：０c08", "squad​_v2|0c08", "squad_v2-0c08", "squad_v2_0c08"]
    other = ["squad_v2:0c0:8", "squad_v2:0c09", "nq_open:0c08", "squad_v2:0c08:1"]
    rows = spark.createDataFrame([(f"squad_v2:i{k}", v) for k, v in enumerate(same + other)], ITEMS)
    keys = {r["value"]: r["key"] for r in m.keyed(rows).collect()}
    assert len({keys[v] for v in same}) == 1
    assert len({keys[v] for v in other} | {keys[same[0]]}) == 5


def test_ties_run_through_items_and_groups(spark):
    chain = [(f"d:{k}", f"d:g{k + j}") for k in range(40) for j in (0, 1)]  # item k ties group k to k + 1
    out = run(spark, [*chain, ("e:1", "e:g")])
    assert len({r["split"] for r in out if r["item_id"].startswith("d:")}) == 1
    assert len({r["part"] for r in out}) == 2


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(330)] + [("hub", f"s{k}") for k in range(300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (None, "n1"), ("n2", None)], "a string, b string"), "a", "b").collect()}
    used = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == used
    assert len({(find(x), got[x]) for x in used}) == len({find(x) for x in used}) == len(set(got.values()))


def test_no_item_and_group_in_two_splits_and_shares_are_met(spark, extra):
    rng = random.Random(1)
    rows = [(f"a:{k}", None if rng.random() < 0.5 else f"a:g{int(rng.paretovariate(0.8)) % 60}") for k in range(900)]
    rows += rows[:50] + [(f"a:{k}", f"a:g{rng.randrange(60)}") for k in range(5)]
    out = run(spark, rows, extra)
    assert len(out) == len(rows)
    for c in ("item_id", "key"):
        seen = {}
        for r in out:
            assert seen.setdefault(r[c], r["split"]) == r["split"]
    share = {s: sum(r["split"] == s for r in out) / len(out) for s, _ in PLAN}
    assert all(abs(share[s] - p) < 0.01 for s, p in PLAN), share
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, run(spark, rows, extra)), key=str)


def test_a_hot_group_goes_where_it_fits(spark):
    rows = [(f"a:{k}", "a:hot") for k in range(300)] + [(f"a:s{k}", None) for k in range(600)]
    out = run(spark, rows)
    assert {r["split"] for r in out if r["key"] == "a:hot"} == {"train"}
    assert sum(r["split"] == "test" for r in out) == 90


def test_nulls_and_empty_tables(spark):
    out = run(spark, [(None, None), (None, "a:g"), ("a:1", "a:g"), ("a:2", ""), ("", None), (None, None)])
    assert len(out) == 6 and all(r["split"] for r in out)
    assert run(spark, []) == []


def test_flow_is_least_cost():
    net = Network()
    arcs = [net.arc("s", "a", 5), net.arc("s", "b", 4, 2), net.arc("a", "t", 3, 1), net.arc("a", "b", 9, 0), net.arc("b", "t", 5, 3)]
    assert net.send("s", "t") == (8, 3 * 1 + 2 * 3 + 3 * 5)
    assert [net.sent(a) for a in arcs] == [5, 3, 3, 2, 5]


def test_allocation_is_whole_and_near_quota():
    bundles = [(50, "x", 1), (7, "x", 9), (3, "y", 20), (1, "y", 200), (1, "x", 77)]
    out = m.allocate(bundles, PLAN)
    assert [sum(o) for o in out] == [n for _, _, n in bundles]
    total = sum(s * n for s, _, n in bundles)
    for k, (_, p) in enumerate(PLAN):
        assert abs(sum(o[k] * b[0] for o, b in zip(out, bundles)) - p * total) <= 1
    with pytest.raises(ValueError):
        m.quotas(5, [("a", 0.0), ("b", None)])


def test_found_on_the_small_tables(spark, small):
    got = [tuple(r) for r in m.p1_found(spark, small).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)


def test_more_kinds_than_bundles(spark, monkeypatch):
    """The rarest kinds share bundles by size; no row is lost and the shares hold."""
    monkeypatch.setattr(m, "KINDS", 3)
    rng = random.Random(5)
    rows = [(f"{'abcd'[k % 4]}:{k}", f"g:{int(rng.paretovariate(0.7)) % 90}") for k in range(3000)]
    out = run(spark, rows)
    assert len(out) == len(rows)
    per = {}
    for r in out:
        per.setdefault(r["part"], set()).add(r["split"])
    assert all(len(s) == 1 for s in per.values())
    biggest = max(sum(r["part"] == p for r in out) for p in per)
    for name, share in PLAN:
        assert abs(sum(r["split"] == name for r in out) - share * len(rows)) <= biggest


def test_sizes_in_classes(spark):
    got = [r[0] for r in spark.createDataFrame([(1,), (999,), (1000,), (1009,), (123456,)], "s long").select(m.size_class(m.F.col("s"))).collect()]
    assert got == [1, 999, 1000, 1000, 123000]


def test_a_component_of_many_values_is_dealt_over_tasks(spark, small, monkeypatch):
    want = sorted(tuple(r) for r in m.p1_found(spark, small).collect())
    monkeypatch.setattr(m, "PAIRED", 2)
    assert sorted(tuple(r) for r in m.p1_found(spark, small).collect()) == want
