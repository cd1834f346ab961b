"""SQL for the same values as in ``expressions``, for the side-by-side comparison."""

from __future__ import annotations


def with_(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts) + "\n"


def confusion(y: str = "y", pred: str = "pred") -> str:
    cells = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    return ", ".join(f"cast(count(*) filter (where {y} = {a} and {pred} = {b}) as bigint) as {k}" for k, (a, b) in cells.items())


def mcc(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn") -> str:
    a, b, c, d = (f"cast({x} as double)" for x in (tp, fp, fn, tn))
    return f"coalesce(({a} * {d} - {b} * {c}) / nullif(sqrt(({a} + {b}) * ({a} + {c}) * ({d} + {b}) * ({d} + {c})), 0), 0)"


def kappa(a: str, b: str, c: str, d: str) -> str:
    a, b, c, d = (f"cast({x} as double)" for x in (a, b, c, d))
    n = f"({a} + {b} + {c} + {d})"
    po = f"({a} + {d}) / nullif({n}, 0)"
    pe = f"(({a} + {b}) * ({a} + {c}) + ({c} + {d}) * ({b} + {d})) / nullif({n} * {n}, 0)"
    return f"case when {a} = {n} or {d} = {n} then null else (({po}) - ({pe})) / nullif(1 - ({pe}), 0) end"


def accuracy() -> str:
    return "(tp + tn) / nullif(cast(tp + fp + fn + tn as double), 0)"


def f1() -> str:
    return "coalesce(2e0 * tp / nullif(cast(2 * tp + fp + fn as double), 0), 0)"


def precision() -> str:
    return "coalesce(tp / nullif(cast(tp + fp as double), 0), 0)"


def recall() -> str:
    return "coalesce(tp / nullif(cast(tp + fn as double), 0), 0)"


def balanced() -> str:
    return "(tp / nullif(cast(tp + fn as double), 0) + tn / nullif(cast(tn + fp as double), 0)) / 2"


def auroc(source: str, by: str, name: str = "roc") -> str:
    """CTEs that end in ``name``(by…, n_pos, n_neg, auroc)."""
    return f"""
{name}_d as (select {by}, score as s, sum(y) as pos, sum(1 - y) as neg from {source} where score is not null and y is not null group by all),
{name}_c as (select *, coalesce(sum(neg) over (partition by {by} order by s rows between unbounded preceding and 1 preceding), 0) as below from {name}_d),
{name} as (select {by}, cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg,
             sum(cast(pos as double) * (below + neg / 2e0)) / nullif(cast(sum(pos) as double) * sum(neg), 0) as auroc
           from {name}_c group by all)"""


SCOPES = "unnest(list_filter(['pooled', dataset, case when dataset <> 'coqa' then 'pooled_no_coqa' end], lambda x: x is not null))"


def scoped(source: str, name: str = "sc") -> str:
    return f"{name} as (select *, {SCOPES} as scope from {source})"


def threshold(source: str, by: str, name: str = "thr") -> str:
    """CTEs that end in ``name``(by…, threshold, mcc)."""
    return f"""
{name}_d as (select {by}, score as s, sum(y) as pos, sum(1 - y) as neg from {source} where score is not null and y is not null group by all),
{name}_c as (select *, coalesce(sum(pos) over w, 0) as fn, coalesce(sum(neg) over w, 0) as tn, lag(s) over (partition by {by} order by s) as prev,
               sum(pos) over (partition by {by}) as p, sum(neg) over (partition by {by}) as n
             from {name}_d window w as (partition by {by} order by s rows between unbounded preceding and 1 preceding)),
{name}_m as (select *, (s + prev) / 2e0 as t, {mcc('(p - fn)', '(n - tn)', 'fn', 'tn')} as m from {name}_c),
{name}_b as (select {by}, arg_max(t, struct_pack(m := m, t := -t)) as t, arg_max(m, struct_pack(m := m, t := -t)) as m from {name}_m where prev is not null group by all),
{name} as (select {', '.join('k.' + c.strip() for c in by.split(','))}, coalesce(b.t, 0.5e0) as threshold, coalesce(b.m, 0e0) as mcc
           from (select distinct {by} from {name}_d) k left join {name}_b b using ({by}))"""


def logistic(source: str, d: int, name: str = "lo", c: float = 1.0, steps: int = 12) -> str:
    """CTEs that end in ``name``(item_id, fold, y, score): out-of-fold scores of ``source``(item_id, fold, y, x double[]).

    Newton steps with the equations solved by elimination, so another way than the one it is compared
    with. The statement has to begin with ``with recursive``.
    """
    n, e = name, d + 1
    parts = [
        f"{n}_f as (select distinct fold as held from {source})",
        f"{n}_s as (select held, i, avg(v) as m, case when stddev_pop(v) > 1e-12 then stddev_pop(v) else 1e0 end as s from (select fold, unnest(range(1, {d + 1})) as i, unnest(x) as v from {source} where y is not null) u, {n}_f where fold <> held group by all)",
        f"{n}_m as materialized (select held, list(m order by i) as m, list(s order by i) as s from {n}_s group by held)",
        f"{n}_c as (select held, cast(count(*) as double) as n, cast(sum(y) as double) as p from {source}, {n}_f where fold <> held and y is not null group by held)",
        f"{n}_z as materialized (select c.held, y, n / (2 * greatest(1, case when y = 1 then p else n - p end)) as w, list_append(list_transform(range(1, {d + 1}), lambda k: (x[k] - m[k]) / s[k]), 1e0) as z from {source} t join {n}_c c on t.fold <> c.held join {n}_m m on m.held = c.held where y is not null)",
        f"{n}_b0 as materialized (select held, list_transform(range(0, {e}), lambda k: 0e0) as b from {n}_c)",
    ]
    for k in range(steps):
        ridge = f"case when i = {e} then 1e-9 else {1.0 / c!r}e0 end"
        parts += [
            f"{n}_q{k} as materialized (select z.held, w, z, y, 1 / (1 + exp(-list_dot_product(z, b))) as q from {n}_z z join {n}_b{k} b using (held))",
            f"{n}_h{k} as (select held, i, j, sum(w * q * (1 - q) * z[i] * z[j]) as h from {n}_q{k}, (select unnest(range(1, {e + 1})) as i), (select unnest(range(1, {e + 1})) as j) where j <= i group by all)",
            f"{n}_g{k} as (select held, i, sum(w * (q - y) * z[i]) as g from {n}_q{k}, (select unnest(range(1, {e + 1})) as i) group by all)",
            f"{n}_l{k} as (select held, i, j, h from {n}_h{k} union all select held, j, i, h from {n}_h{k} where i <> j union all select g.held, i, {e + 1}, g + {ridge} * b[i] from {n}_g{k} g join {n}_b{k} b using (held))",
            f"{n}_r{k} as (select held, i, list(h + case when i = j then {ridge} else 0e0 end order by j) as r from {n}_l{k} group by all)",
            f"{n}_e{k}(held, k, a) as (select held, 0, list(r order by i) from {n}_r{k} group by held union all select held, k + 1, list_transform(range(1, {e + 1}), lambda i: case when i = k + 1 then p else list_transform(range(1, {e + 2}), lambda j: a[i][j] - a[i][k + 1] * p[j]) end) from (select held, k, a, list_transform(a[k + 1], lambda v: v / a[k + 1][k + 1]) as p from {n}_e{k} where k < {e}) t)",
            f"{n}_b{k + 1} as materialized (select held, list_transform(range(1, {e + 1}), lambda i: b[i] - a[i][{e + 1}]) as b from {n}_b{k} join {n}_e{k} using (held) where k = {e})",
        ]
    parts.append(f"{n} as materialized (select item_id, fold, y, 1 / (1 + exp(-list_dot_product(list_append(list_transform(range(1, {d + 1}), lambda k: (x[k] - m[k]) / s[k]), 1e0), b))) as score from {source} t join {n}_m m on m.held = t.fold join {n}_b{steps} b on b.held = t.fold)")
    return ",\n".join(parts)
