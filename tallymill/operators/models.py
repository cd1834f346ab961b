"""Model fitting over folds: exact distributed logistic regression, and fits on bounded samples.

``logistic_oof`` fits all folds at once: every step is one pass whose tasks return sums per fold. The
sums are added by Spark in a tree, so the driver sees one row per fold whatever the number of tasks.
Narrow blocks take Newton steps; blocks of more than WIDE columns take quasi-Newton steps, which need
gradients only.

``sampled_oof`` fits any NumPy models on at most ``BOUND`` training rows of each held-out fold (one
task per fold), then scores every row in one pass. A fit is told which of its rows validate: the first
of four inner folds over whole groups, where penalties, layers and thresholds are chosen.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.expressions import order_hash
from tallymill.session import cut

BOUND = 20_000  # training rows per fold of a sampled fit
WIDE = 512  # columns from which no matrix of second derivatives is made
BRANCH = 64  # rows that one task of the tree adds up
CELLS = "fold int, part int, s binary"


def matrix(col: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in col]) if len(col) else np.zeros((0, 0))


def _totals(df: DataFrame, work: Callable[[np.ndarray, np.ndarray, int], np.ndarray], folds: list[int]) -> dict[int, np.ndarray]:
    """Sums of ``work(x, y, held)`` over the rows outside each held fold."""

    return {r["fold"]: np.frombuffer(r["s"], float) for r in added(df, work, folds).collect()}  # a row per fold


def added(df: DataFrame, work: Callable[[np.ndarray, np.ndarray, int], np.ndarray], folds: list[int]) -> DataFrame:
    """(fold, part, s): one row per fold, added up in a tree of tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in parts:
            if not len(pdf):
                continue
            x, y, f = matrix(pdf["x"]), pdf["y"].to_numpy(float), pdf["fold"].to_numpy()
            for held in folds:
                own = f != held
                if own.any():
                    s = work(x[own], y[own], held)
                    total[held] = total[held] + s if held in total else s
        if total:
            yield pd.DataFrame({"fold": list(total), "part": TaskContext.get().partitionId(), "s": [v.tobytes() for v in total.values()]})

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for pdf in parts:
            for fold, part, raw in zip(pdf["fold"], pdf["part"], pdf["s"], strict=True):
                v = np.frombuffer(raw, float)
                total[fold, part] = total[fold, part] + v if (fold, part) in total else v
        if total:
            yield pd.DataFrame({"fold": [k[0] for k in total], "part": [k[1] for k in total], "s": [v.tobytes() for v in total.values()]})

    sums = df.select("x", "y", "fold").mapInPandas(run, CELLS)
    tasks = df.rdd.getNumPartitions()
    while True:
        tasks = -(-tasks // BRANCH)
        sums = sums.withColumn("part", F.floor(F.col("part") / BRANCH).cast("int") if tasks > 1 else F.lit(0))
        sums = sums.repartition(max(1, tasks * len(folds)), "fold", "part").mapInPandas(add, CELLS)
        if tasks == 1:
            return sums


def moments(df: DataFrame, folds: list[int], second: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray | None, float]]:
    """Per held fold over the other rows: mean, population deviation (1 where 0), second moments if asked for, rows."""

    def work(x: np.ndarray, y: np.ndarray, held: int) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel() if second else (x * x).sum(axis=0)])

    out = {}
    for held, v in _totals(df, work, folds).items():
        n = v[0]
        d = int(round((-1 + np.sqrt(1 + 4 * (len(v) - 1))) / 2)) if second else (len(v) - 1) // 2
        mean = v[1 : 1 + d] / n
        both = v[1 + d :].reshape(d, d) / n if second else None
        square = np.diag(both) if second else v[1 + d :] / n
        sd = np.sqrt(np.maximum(square - mean * mean, 0))
        out[held] = (mean, np.where(sd > 1e-12, sd, 1.0), both, n)
    return out


class Descent:
    """Limited-memory quasi-Newton steps: take ``point``, tell its loss and gradient, until ``done``."""

    def __init__(self, size: int, memory: int = 12, tolerance: float = 1e-8) -> None:
        self.x = self.point = np.zeros(size)
        self.loss, self.memory, self.tolerance, self.done = np.inf, memory, tolerance, False
        self.grad = self.way = np.zeros(size)
        self.length, self.pairs = 1.0, []

    def tell(self, loss: float, grad: np.ndarray) -> None:
        if np.isfinite(self.loss) and loss > self.loss + 1e-4 * self.length * float(self.grad @ self.way):
            self.length /= 2  # too far
            self.done = self.length < 1e-10
            self.point = self.x + self.length * self.way
            return
        if np.isfinite(self.loss):
            s, g = self.point - self.x, grad - self.grad
            if s @ g > 1e-14:
                self.pairs = [*self.pairs, (s, g, 1.0 / (s @ g))][-self.memory :]
        self.x, self.loss, self.grad = self.point, loss, grad
        self.done = bool(np.abs(grad).max(initial=0.0) <= self.tolerance * max(1.0, abs(loss)))
        q, kept = grad.copy(), []
        for s, g, r in reversed(self.pairs):
            a = r * (s @ q)
            kept.append(a)
            q = q - a * g
        if self.pairs:
            s, g, r = self.pairs[-1]
            q = q / (r * (g @ g))
        for (s, g, r), a in zip(self.pairs, reversed(kept), strict=True):
            q = q + s * (a - r * (g @ q))
        self.way = -q
        self.length = 1.0 if self.pairs else 1.0 / max(1.0, float(np.linalg.norm(grad)))
        self.point = self.x + self.length * self.way


ARM = 1000  # a fold and an arm are one number: fold times ARM plus arm


def logistic_oof(df: DataFrame, c: float = 1.0, steps: int = 12, arms: dict[str, list[int]] | None = None) -> DataFrame:
    """(item_id, fold, y, [method,] score) of rows (item_id, fold, y, x array<double>): each scored by the fit without its fold.

    L2-penalised, classes weighted inversely to their size, columns standardised on the training rows
    with population deviations; the intercept is not penalised. Null labels are scored, not fitted.
    ``arms`` are named sets of columns; all of them, in all folds, are fitted by the same passes.
    """
    df = cut(df.select("item_id", "fold", "y", "x"), "rows")  # every step reads it again
    folds = sorted(r[0] for r in df.select("fold").distinct().collect())
    train = df.filter("y is not null")
    mom = moments(train, folds, second=False)
    counts = {r["fold"]: (r["p"], r["n"]) for r in train.groupBy("fold").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect()}
    d = len(next(iter(mom.values()))[0]) if mom else 0
    names = list(arms) if arms else [""]
    columns = [np.array(arms[n]) for n in names] if arms else [np.arange(d)]
    weight, scale = {}, {h: mom[h][:2] for h in mom}
    for held in folds:
        p = sum(a for f, (a, _) in counts.items() if f != held)
        n = sum(b for f, (_, b) in counts.items() if f != held)
        weight[held] = (n / (2.0 * max(1, n - p)), n / (2.0 * max(1, p)))
    every = _newton_steps if max((len(c) for c in columns), default=0) <= WIDE else _gradient_steps
    beta = every(train, scale, weight, columns, c, steps)
    models = {h: [(n, "logistic", {"mean": scale[h][0][cols], "sd": scale[h][1][cols], "w": beta[h * ARM + k], "columns": cols}) for k, (n, cols) in enumerate(zip(names, columns, strict=True))] for h in scale}
    out = scored(df, models)
    return out if arms else out.drop("method")


def _newton_steps(train: DataFrame, scale: dict, weight: dict, columns: list[np.ndarray], c: float, steps: int) -> dict[int, np.ndarray]:
    beta = {h * ARM + k: np.zeros(len(cols) + 1) for h in scale for k, cols in enumerate(columns)}
    for _ in range(steps):
        now = dict(beta)

        def work(x: np.ndarray, y: np.ndarray, held: int, now: dict = now) -> np.ndarray:
            full = (x - scale[held][0]) / scale[held][1]
            w = np.where(y > 0, weight[held][1], weight[held][0])
            parts = []
            for k, cols in enumerate(columns):
                z = np.hstack([full[:, cols], np.ones((len(x), 1))])
                p = 1.0 / (1.0 + np.exp(-z @ now[held * ARM + k]))
                parts += [z.T @ (w * (p - y)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()]
            return np.concatenate(parts)

        move = 0.0
        for held, v in _totals(train, work, list(scale)).items():
            at = 0
            for k, cols in enumerate(columns):
                size = len(cols) + 1
                g, h = v[at : at + size].copy(), v[at + size : at + size + size * size].reshape(size, size).copy()
                at += size + size * size
                ridge = np.append(np.full(size - 1, 1.0 / c), 1e-9)
                step = np.linalg.solve(h + np.diag(ridge), g + ridge * now[held * ARM + k])
                beta[held * ARM + k] = now[held * ARM + k] - step
                move = max(move, float(np.abs(step).max()))
        if move < 1e-8:
            break
    return beta


def _gradient_steps(train: DataFrame, scale: dict, weight: dict, columns: list[np.ndarray], c: float, steps: int) -> dict[int, np.ndarray]:
    """The same minimum from losses and gradients, for blocks whose second derivatives are too many; up to 25 passes a step."""
    state = {h * ARM + k: Descent(len(cols) + 1) for h in scale for k, cols in enumerate(columns)}
    for _ in range(25 * steps):
        now = {k: d.point for k, d in state.items() if not d.done}
        open_ = sorted({k // ARM for k in now})
        if not open_:
            break

        def work(x: np.ndarray, y: np.ndarray, held: int, now: dict = now) -> np.ndarray:
            full = (x - scale[held][0]) / scale[held][1]
            w = np.where(y > 0, weight[held][1], weight[held][0])
            parts = []
            for k, cols in enumerate(columns):
                if held * ARM + k in now:
                    z = np.hstack([full[:, cols], np.ones((len(x), 1))])
                    t = z @ now[held * ARM + k]
                    parts += [[(w * (np.logaddexp(0.0, t) - y * t)).sum()], z.T @ (w * (1.0 / (1.0 + np.exp(-t)) - y))]
            return np.concatenate(parts)

        for held, v in _totals(train, work, open_).items():
            at = 0
            for k, cols in enumerate(columns):
                key = held * ARM + k
                if key in now:
                    ridge = np.append(np.full(len(cols), 1.0 / c), 1e-9)
                    loss, grad = v[at] + float(ridge @ now[key] ** 2) / 2, v[at + 1 : at + len(cols) + 2] + ridge * now[key]
                    state[key].tell(float(loss), grad)
                    at += len(cols) + 2
    return {k: d.x for k, d in state.items()}


def scored(df: DataFrame, models: dict[int, list[tuple[str, str, dict]]]) -> DataFrame:
    """(item_id, fold, y, method, score, pred): every row by the models of its own (held-out) fold.

    The decision is by the model's threshold, 0.5 without one.
    """
    kind = df.schema["item_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if not len(pdf):
                continue
            x, f = matrix(pdf["x"]), pdf["fold"].to_numpy()
            for held, own_models in models.items():
                own = f == held
                for method, name, p in own_models if own.any() else []:
                    s = predict(name, p, x[own])
                    yield pd.DataFrame({"item_id": pdf["item_id"][own], "fold": pdf["fold"][own], "y": pdf["y"][own], "method": method, "score": s, "pred": (s >= p.get("threshold", 0.5)).astype(int)})

    return df.select("item_id", "fold", "y", "x").mapInPandas(run, f"item_id {kind}, fold int, y int, method string, score double, pred int")


def predict(name: str, p: dict, x: np.ndarray) -> np.ndarray:
    cols = p.get("columns")
    return PREDICT[name](p, x if cols is None else x[:, cols])


Fit = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[str, dict]]


def sampled(df: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], object], bound: int = BOUND, inner: int = 4) -> dict[int, object]:
    """``work(x, y, validates)`` of at most ``bound`` rows of each training part, in hash order, by held fold.

    ``df`` has item_id, fold, y, x, and group_id and dataset where groups are to stay whole between the
    inner folds; without them items are their own groups.
    """
    for c in ("group_id", "dataset"):
        df = df if c in df.columns else df.withColumn(c, F.col("item_id").cast("string") if c == "group_id" else F.lit(""))
    rows = cut(df.filter("y is not null").select(F.coalesce("group_id", F.col("item_id").cast("string")).alias("group_id"), "dataset", "item_id", "fold", "y", "x"), "training")
    folds = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    parts = None
    for held in folds:
        p = rows.filter(F.col("fold") != held).orderBy(order_hash(F.lit("fit"), F.col("item_id").cast("string")), "item_id").limit(bound).withColumn("held", F.lit(held))
        parts = p if parts is None else parts.unionByName(p)
    if parts is None:
        return {}
    # Within a training part, a hash puts whole groups into inner folds; the first one validates.
    chance = F.conv(F.substring(order_hash(F.lit("inner"), F.col("held").cast("string"), "group_id"), 1, 6), 16, 10).cast("long") % inner
    parts = parts.withColumn("validates", chance == 0)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id")
        return pd.DataFrame({"held": [int(pdf["held"].iloc[0])], "model": [pickle.dumps(work(matrix(pdf["x"]), pdf["y"].to_numpy(float), pdf["validates"].to_numpy(bool)))]})

    got = parts.select("held", "item_id", "y", "x", "validates").groupBy("held").applyInPandas(one, "held int, model binary").collect()  # a model per fold
    return {r["held"]: pickle.loads(r["model"]) for r in got}


def sampled_oof(df: DataFrame, fits: Callable | dict[str, Fit], bound: int = BOUND) -> DataFrame:
    """Out-of-fold scores and decisions of models fitted on bounded samples.

    ``fits`` is one fit of (x, y), or fits of (x, y, validates) by name; names come out as ``method``.
    """
    named = fits if isinstance(fits, dict) else {"": lambda x, y, v: fits(x, y)}
    kept = cut(df, "rows")
    got = sampled(kept, lambda x, y, v: [(n, *f(x, y, v)) for n, f in named.items()], bound)
    out = scored(kept, got)
    return out if isinstance(fits, dict) else out.drop("method", "pred")


# Fits on one sample. Each gives the name of its predictor and the parameters.


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sd = x.std(axis=0)
    return x.mean(axis=0), np.where(sd > 1e-12, sd, 1.0)


def _newton(z: np.ndarray, y: np.ndarray, c: float, steps: int = 25) -> np.ndarray:
    z = np.hstack([z, np.ones((len(z), 1))])
    n, p = len(y), y.sum()
    w = np.where(y > 0, n / (2 * max(1.0, p)), n / (2 * max(1.0, n - p)))
    ridge = np.append(np.full(z.shape[1] - 1, 1.0 / c), 1e-9)
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-z @ beta))
        g = z.T @ (w * (q - y)) + ridge * beta
        step = np.linalg.solve((z * (w * q * (1 - q))[:, None]).T @ z + np.diag(ridge), g)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def auroc(s: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(s, kind="stable")
    _, first, n = np.unique(s[order], return_index=True, return_counts=True)
    rank = np.repeat(first + (n + 1) / 2.0, n)
    pos = y[order] > 0
    p, q = pos.sum(), (~pos).sum()
    return 0.5 if not p or not q else float((rank[pos].sum() - p * (p + 1) / 2) / (p * q))


C_GRID = (0.003, 0.03, 0.3, 3.0)  # Fixed values: penalties tried


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> tuple[str, dict]:
    m, s = _standard(x)
    return "logistic", {"mean": m, "sd": s, "w": _newton((x - m) / s, y, c)}


def cutoff(s: np.ndarray, y: np.ndarray) -> float:
    """The midpoint of neighbouring scores with the best MCC, the lowest of equals; 0.5 if there is none."""
    order = np.argsort(s, kind="stable")
    s, y = s[order], y[order] > 0
    edge = np.flatnonzero(np.diff(s) > 0)
    if not len(edge):
        return 0.5
    fn, tn = np.cumsum(y)[edge].astype(float), np.cumsum(~y)[edge].astype(float)
    tp, fp = y.sum() - fn, (~y).sum() - tn
    den = np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = np.where(den > 0, (tp * tn - fp * fn) / np.maximum(den, 1e-300), 0.0).round(12)
    k = edge[int(mcc.argmax())]
    return float((s[k] + s[k + 1]) / 2)


def nested(fit: Callable[..., tuple[str, dict]], grid: list[dict]) -> Fit:
    """The protocol of all detectors: parameters by AUROC and threshold by MCC on the validating rows, then a fit on all."""

    def run(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> tuple[str, dict]:
        if not v.any() or v.all() or len(set(y[~v])) < 2:
            return fit(x, y, **grid[0])
        best, most, edge = grid[0], -1.0, 0.5
        for g in grid:
            s = predict(*fit(x[~v], y[~v], **g), x[v])
            a = auroc(s, y[v])
            if a > most:
                best, most, edge = g, a, cutoff(s, y[v])
        name, p = fit(x, y, **best)
        return name, {**p, "threshold": edge, "chosen": best, "inner_auroc": most}

    return run


def on_columns(fit: Callable[..., tuple[str, dict]], columns: list[int] | None = None) -> Callable[..., tuple[str, dict]]:
    """The fit on some columns; a parameter ``layer`` of its grid may name them instead."""

    def run(x: np.ndarray, y: np.ndarray, layer: list[int] | None = None, **g: object) -> tuple[str, dict]:
        cols = layer if layer is not None else columns
        name, p = fit(x[:, cols], y, **g)
        return name, {**p, "columns": np.array(cols)}

    return run


def fit_tuned(x: np.ndarray, y: np.ndarray) -> tuple[str, dict]:
    """The penalty with the best AUROC on an inner quarter, then a fit on all rows."""
    return nested(fit_logistic, [{"c": c} for c in C_GRID])(x, y, np.arange(len(y)) % 4 == 0)


def _pca(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, s = _standard(x)
    _, _, vt = np.linalg.svd((x - m) / s, full_matrices=False)
    return m, s, vt[: min(k, len(vt))]


def fit_pca(x: np.ndarray, y: np.ndarray, k: int = 512, c: float = 1.0) -> tuple[str, dict]:
    m, s, v = _pca(x, k)
    z = (x - m) / s @ v.T
    return "pca", {"mean": m, "sd": s, "v": v, "inner": fit_logistic(z, y, c)[1]}


def fit_block_pca(x: np.ndarray, y: np.ndarray, width: int = 16, k: int = 6, c: float = 1.0, edges: list[int] | None = None) -> tuple[str, dict]:
    """Each block to its own components; a block that is narrow already passes as it is."""
    m, s = _standard(x)
    z = (x - m) / s
    rows = []
    edges = edges or [*range(0, x.shape[1], width), x.shape[1]]
    for a, end in zip(edges[:-1], edges[1:], strict=True):
        own = z[:, a:end]
        v = np.linalg.svd(own, full_matrices=False)[2][:k] if own.shape[1] > k else np.eye(own.shape[1])
        full = np.zeros((len(v), x.shape[1]))
        full[:, a : a + own.shape[1]] = v
        rows.append(full)
    v = np.vstack(rows)
    return "pca", {"mean": m, "sd": s, "v": v, "inner": fit_logistic(z @ v.T, y, c)[1]}


def fit_lda(x: np.ndarray, y: np.ndarray) -> tuple[str, dict]:
    """Linear discriminant with a shrunken covariance (Ledoit and Wolf's estimate of the shrinkage)."""
    m, s = _standard(x)
    z = (x - m) / s
    mu = [z[y == k].mean(axis=0) if (y == k).any() else np.zeros(z.shape[1]) for k in (0, 1)]
    r = z - np.where(y[:, None] > 0, mu[1], mu[0])
    n, d = r.shape
    cov = r.T @ r / n
    t = np.trace(cov) / d
    spread = ((r**2).T @ (r**2) / n - cov**2).sum() / n
    shrink = min(1.0, spread / max(((cov - t * np.eye(d)) ** 2).sum(), 1e-12))
    cov = (1 - shrink) * cov + shrink * t * np.eye(d)
    w = np.linalg.solve(cov, mu[1] - mu[0])
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    return "logistic", {"mean": m, "sd": s, "w": np.append(w, np.log(p / (1 - p)) - w @ (mu[0] + mu[1]) / 2)}


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 0.1, steps: int = 30) -> tuple[str, dict]:
    """Squared hinge loss, by Newton steps on the rows inside the margin."""
    m, s = _standard(x)
    z = np.hstack([(x - m) / s, np.ones((len(x), 1))])
    t, w = np.where(y > 0, 1.0, -1.0), np.zeros(x.shape[1] + 1)
    ridge = np.append(np.ones(x.shape[1]), 1e-9)
    for _ in range(steps):
        own = t * (z @ w) < 1
        a = z[own]
        new = np.linalg.solve(np.diag(ridge) + 2 * c * a.T @ a, 2 * c * a.T @ t[own])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return "linear", {"mean": m, "sd": s, "w": w, "threshold": 0.0}


def fit_fourier(x: np.ndarray, y: np.ndarray, k: int = 128) -> tuple[str, dict]:
    """Random Fourier features of a radial kernel, then logistic regression."""
    m, s = _standard(x)
    rng = np.random.default_rng(0)
    w, b = rng.normal(0, np.sqrt(1.0 / x.shape[1]), (x.shape[1], k)), rng.uniform(0, 2 * np.pi, k)
    z = np.sqrt(2.0 / k) * np.cos((x - m) / s @ w + b)
    return "fourier", {"mean": m, "sd": s, "w": w, "b": b, "inner": fit_logistic(z, y)[1]}


def fit_mlp(x: np.ndarray, y: np.ndarray, sizes: tuple[int, ...] = (128, 64, 32), epochs: int = 60, rate: float = 3e-3, patience: int = 8, blocks: list[int] | None = None) -> tuple[str, dict]:
    """Rectified layers by Adam with early stopping on a tenth of the rows.

    With ``blocks``, the edges of the columns' blocks, the first layer is one encoder per block: its
    units are dealt evenly and each sees its own block only.
    """
    m, s = _standard(x)
    z = (x - m) / s
    rng = np.random.default_rng(0)
    held = np.arange(len(y)) % 10 == 0
    dims = [x.shape[1], *sizes, 1]
    ws = [rng.normal(0, np.sqrt(2.0 / a), (a, b)) for a, b in zip(dims[:-1], dims[1:], strict=True)]
    if blocks:
        mask = np.zeros_like(ws[0])
        for k, own in enumerate(np.array_split(np.arange(dims[1]), len(blocks) - 1)):
            mask[blocks[k] : blocks[k + 1], own] = 1.0
        ws[0] *= mask
    bs = [np.zeros(b) for b in dims[1:]]
    par = ws + bs
    mom, sec, t = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    best, kept, quiet = -1.0, [p.copy() for p in par], 0
    rows = np.flatnonzero(~held)
    pos = y[rows].mean() if len(rows) else 0.5
    weight = np.where(y > 0, 0.5 / max(pos, 1e-6), 0.5 / max(1 - pos, 1e-6))
    for _ in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), 128):
            own = rows[at : at + 128]
            acts = [z[own]]
            for k, (w, b) in enumerate(zip(ws, bs, strict=True)):
                h = acts[-1] @ w + b
                acts.append(np.maximum(h, 0) if k < len(ws) - 1 else h)
            g = ((1 / (1 + np.exp(-acts[-1][:, 0])) - y[own]) * weight[own] / len(own))[:, None]
            grads_w, grads_b = [], []
            for k in range(len(ws) - 1, -1, -1):
                grads_w.insert(0, acts[k].T @ g + 1e-4 * ws[k])
                grads_b.insert(0, g.sum(axis=0))
                if k:
                    g = (g @ ws[k].T) * (acts[k] > 0)
            if blocks:
                grads_w[0] *= mask
            t += 1
            for k, gr in enumerate(grads_w + grads_b):
                mom[k] = 0.9 * mom[k] + 0.1 * gr
                sec[k] = 0.999 * sec[k] + 0.001 * gr * gr
                par[k] -= rate * (mom[k] / (1 - 0.9**t)) / (np.sqrt(sec[k] / (1 - 0.999**t)) + 1e-8)
        p = {"mean": m, "sd": s, "ws": ws, "bs": bs}
        a = auroc(PREDICT["mlp"](p, x[held]), y[held]) if held.any() else 0.0
        if a > best:
            best, kept, quiet = a, [q.copy() for q in par], 0
        else:
            quiet += 1
            if quiet >= patience:
                break
    n = len(ws)
    return "mlp", {"mean": m, "sd": s, "ws": kept[:n], "bs": kept[n:]}


def _radial(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1) - 2 * x @ z.T
    return np.exp(-gamma * np.maximum(d, 0))


KERNEL_ROWS = 2_000  # training rows of a kernel machine, drawn from the fold's


def fit_radial(x: np.ndarray, y: np.ndarray, c: float = 1.0, gamma: float = 1.0, steps: int = 20) -> tuple[str, dict]:
    """Support vectors with a radial kernel and squared hinge loss, by Newton steps on the rows inside the margin.

    ``gamma`` is in units of one over the number of columns.
    """
    drawn = np.random.default_rng(0).permutation(len(y))[:KERNEL_ROWS]
    x, y = x[drawn], y[drawn]
    m, s = _standard(x)
    z, t, g = (x - m) / s, np.where(y > 0, 1.0, -1.0), gamma / x.shape[1]
    k = _radial(z, z, g)
    share = max(1.0, (y > 0).sum()), max(1.0, (y <= 0).sum())
    w = np.where(y > 0, len(y) / (2 * share[0]), len(y) / (2 * share[1]))
    beta, bias, own = np.zeros(len(y)), 0.0, np.ones(len(y), bool)
    for _ in range(steps):
        n = int(own.sum())
        a = np.zeros((n + 1, n + 1))
        a[:n, :n] = k[np.ix_(own, own)] + np.diag(1.0 / (2 * c * w[own]))
        a[:n, n] = a[n, :n] = 1.0
        sol = np.linalg.solve(a, np.append(t[own], 0.0))
        beta = np.zeros(len(y))
        beta[own], bias = sol[:n], sol[n]
        inside = t * (k @ beta + bias) < 1
        if (inside == own).all() or not inside.any():
            break
        own = inside
    kept = beta != 0
    return "radial", {"mean": m, "sd": s, "gamma": g, "at": z[kept], "beta": beta[kept], "bias": bias, "threshold": 0.0}


def fit_nystroem(x: np.ndarray, y: np.ndarray, c: float = 1.0, gamma: float = 1.0, k: int = 256) -> tuple[str, dict]:
    """A radial kernel's features by k landmark rows, then logistic regression."""
    m, s = _standard(x)
    z, g = (x - m) / s, gamma / x.shape[1]
    at = z[np.random.default_rng(0).permutation(len(z))[:k]]
    values, vectors = np.linalg.eigh(_radial(at, at, g))
    kept = values > 1e-10 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    return "nystroem", {"mean": m, "sd": s, "gamma": g, "at": at, "whiten": whiten, "inner": fit_logistic(_radial(z, at, g) @ whiten, y, c)[1]}


def fit_softmax(z: np.ndarray, labels: np.ndarray, kinds: int, c: float = 1.0, steps: int = 200) -> np.ndarray:
    """Weights (columns and one more, by kind) of a multinomial logistic model."""
    z = np.hstack([z, np.ones((len(z), 1))])
    hot = (labels[:, None] == np.arange(kinds)).astype(float)
    d = Descent(z.shape[1] * kinds, tolerance=1e-6)
    for _ in range(steps):
        w = d.point.reshape(z.shape[1], kinds)
        t = z @ w
        t = t - t.max(axis=1, keepdims=True)
        log = t - np.log(np.exp(t).sum(axis=1, keepdims=True))
        d.tell(float(-(hot * log).sum() + (w[:-1] ** 2).sum() / (2 * c)), (z.T @ (np.exp(log) - hot) + np.vstack([w[:-1] / c, np.zeros((1, kinds))])).ravel())
        if d.done:
            break
    return d.x.reshape(z.shape[1], kinds)


def with_cutoff(name: str, p: dict, x: np.ndarray, y: np.ndarray) -> tuple[str, dict]:
    return name, {**p, "threshold": cutoff(predict(name, p, x), y)}


def experts(rule: str, kinds: int, least: int = 50) -> Fit:
    """A model per data set (the last column's number) combined by a rule; its threshold from the validating rows.

    Data sets with few training rows or one label have no expert. ``gated`` weighs experts by a model
    of the data set on the same columns, ``own`` asks the row's own expert.
    """

    def run(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> tuple[str, dict]:
        z, tag = x[:, :-1], x[:, -1].astype(int)
        v = v if v.any() and not v.all() else np.arange(len(y)) % 4 == 0
        members = {}
        for t in range(kinds):
            own = (tag == t) & ~v
            if own.sum() >= least and len(set(y[own])) == 2:
                members[t] = fit_logistic(z[own], y[own])[1]
                check = (tag == t) & v
                members[t]["edge"] = cutoff(_logistic(members[t], z[check]), y[check]) if check.any() else 0.5
        m, s, pv = _pca(z[~v], 32)
        p = {"rule": rule, "experts": members, "mean": m, "sd": s, "v": pv, "gate": fit_softmax((z[~v] - m) / s @ pv.T, tag[~v], kinds), "all": fit_logistic(z[~v], y[~v])[1]}
        return with_cutoff("experts", p, x[v], y[v])

    return run


def _experts(p: dict, x: np.ndarray) -> np.ndarray:
    z, tag, names = x[:, :-1], x[:, -1].astype(int), sorted(p["experts"])
    if not names or p["rule"] == "pooled":
        return _logistic(p["all"], z)
    e = np.stack([_logistic(p["experts"][t], z) for t in names], axis=1)
    if p["rule"] == "gated":
        t = np.hstack([(z - p["mean"]) / p["sd"] @ p["v"].T, np.ones((len(z), 1))]) @ p["gate"]
        t = np.exp(t - t.max(axis=1, keepdims=True))
        return (e * (t / t.sum(axis=1, keepdims=True))[:, names]).sum(axis=1)
    if p["rule"] == "own":
        at = np.array([names.index(t) if t in names else -1 for t in tag])
        return np.where(at >= 0, e[np.arange(len(z)), np.maximum(at, 0)], _logistic(p["all"], z))
    if p["rule"] == "hard":
        return (e >= np.array([p["experts"][t]["edge"] for t in names])).mean(axis=1)
    return e.max(axis=1) if p["rule"] == "max" else e.mean(axis=1)


def layer_mix(width: int, top: int) -> Fit:
    """The mean of the probes on the layers that are best on the validating rows; ``top`` of one is the best single layer."""

    def run(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> tuple[str, dict]:
        v = v if v.any() and not v.all() else np.arange(len(y)) % 4 == 0
        layers = [np.arange(a, a + width) for a in range(0, x.shape[1], width)]
        seen = [_logistic(fit_logistic(x[~v][:, c], y[~v])[1], x[v][:, c]) for c in layers]
        best = sorted(range(len(layers)), key=lambda k: (-round(auroc(seen[k], y[v]), 12), k))[:top]
        edge = cutoff(np.mean([seen[k] for k in best], axis=0), y[v])
        return "mean", {"parts": [("logistic", {**fit_logistic(x[:, layers[k]], y)[1], "columns": layers[k]}) for k in best], "threshold": edge, "chosen": sorted(best)}

    return run


def last_layers(width: int, k: int, mode: str, dim: int = 16) -> Fit:
    """The last k layers: each to ``dim`` components, to a k-th of them (budget), or all to as many together (joint)."""

    def fit(x: np.ndarray, y: np.ndarray, c: float) -> tuple[str, dict]:
        cols = list(range(x.shape[1] - k * width, x.shape[1]))
        d = dim if mode == "per_layer" else max(4, dim // k)
        edges = [j * width for j in range(k + 1)] if mode != "joint" else [0, k * width]
        name, p = fit_block_pca(x[:, cols], y, k=d if mode != "joint" else d * k, c=c, edges=edges)
        return name, {**p, "columns": np.array(cols)}

    return nested(fit, [{"c": c} for c in C_GRID])


def fit_boosted(x: np.ndarray, y: np.ndarray) -> tuple[str, dict]:
    from tallymill.functions.trees import fit

    return "boosted", {"model": fit(x, y, trees=60, depth=3)}


def _apply_mlp(p: dict, x: np.ndarray) -> np.ndarray:
    h = (x - p["mean"]) / p["sd"]
    for k, (w, b) in enumerate(zip(p["ws"], p["bs"], strict=True)):
        h = h @ w + b
        if k < len(p["ws"]) - 1:
            h = np.maximum(h, 0)
    return 1 / (1 + np.exp(-h[:, 0]))


def _linear(p: dict, x: np.ndarray) -> np.ndarray:
    return np.hstack([(x - p["mean"]) / p["sd"], np.ones((len(x), 1))]) @ p["w"]


def _logistic(p: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-_linear(p, x)))


PREDICT: dict[str, Callable[[dict, np.ndarray], np.ndarray]] = {
    "logistic": _logistic,
    "linear": _linear,
    "pca": lambda p, x: _logistic(p["inner"], (x - p["mean"]) / p["sd"] @ p["v"].T),
    "fourier": lambda p, x: _logistic(p["inner"], np.sqrt(2.0 / len(p["b"])) * np.cos((x - p["mean"]) / p["sd"] @ p["w"] + p["b"])),
    "radial": lambda p, x: _radial((x - p["mean"]) / p["sd"], p["at"], p["gamma"]) @ p["beta"] + p["bias"],
    "nystroem": lambda p, x: _logistic(p["inner"], _radial((x - p["mean"]) / p["sd"], p["at"], p["gamma"]) @ p["whiten"]),
    "experts": _experts,
    "mean": lambda p, x: np.mean([predict(*q, x) for q in p["parts"]], axis=0),
    "mlp": _apply_mlp,
    "boosted": lambda p, x: p["model"].predict(x),
}
