"""Problem 5: consensus from several annotators' labels.

The newest label of each judge on each item counts. Items' votes are packed once into blocks; every
step of the expectation-maximisation is one pass over the blocks, which returns each judge's expected
counts. The driver holds one confusion matrix per judge (nine numbers). With more than MANY judges
the matrices stay in a table and the same step is done by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import LLM
from tallymill.llm.keys import letters_only
from tallymill.session import cut
from tallymill.sources.tables import table

LABELS = ("HALLUCINATED", "INVALID", "NOT_HALLUCINATED")
MANY = 100_000
SMOOTH = 1.0
STEPS, CLOSE = 60, 1e-6


def label_of(c):  # noqa: ANN001, ANN201
    """One of LABELS, or null; marks, case and a lead-in do not matter."""
    s = letters_only(c)
    return (
        F.when(s.contains("unparseable"), None)
        .when(s.contains("nothallucinated"), F.lit("NOT_HALLUCINATED"))
        .when(s.contains("invalid"), F.lit("INVALID"))
        .when(s.contains("hallucinated"), F.lit("HALLUCINATED"))
    )


def counting(verdicts: DataFrame) -> DataFrame:
    """item_id, judge, label that count: each judge's newest label on each item.

    Null and unparseable labels do not count, so the newest of the others does. Rows without item or
    judge are left out; without a time they are the oldest; of labels of one time that of the highest
    verdict_id counts. Repeated rows change nothing.
    """
    rows = verdicts.select("item_id", letters_only(F.col("judge")).alias("judge"), label_of(F.col("label")).alias("label"), "judged_at", "verdict_id")
    rows = rows.filter("item_id is not null and judge is not null and label is not null")
    newest = F.max_by("label", F.struct("judged_at", "verdict_id", "label"))
    return rows.groupBy("item_id", "judge").agg(newest.alias("label"))


class Model:
    """Confusion matrices (true label by given label) and the labels' shares."""

    def __init__(self, names: list[str], confusion: np.ndarray, prior: np.ndarray) -> None:
        self.names, self.confusion, self.prior = names, confusion, prior

    @property
    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.log(self.confusion), np.log(self.prior)


def posterior(judges: np.ndarray, labels: np.ndarray, starts: np.ndarray, logs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Posterior of each item's true label; an item's votes lie between two starts."""
    conf, prior = logs
    score = prior + np.add.reduceat(conf[judges, :, labels], starts[:-1], axis=0)
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True)


def _votes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = batch.column(batch.num_columns - 1)
    starts = v.offsets.to_numpy().astype(np.int64)
    flat = v.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    return flat // len(LABELS), flat % len(LABELS), starts - starts[0]


COUNTS = "judge int, truth int, given int, mass double"


def _counts(packed: DataFrame, model: Model | None, judges: int) -> np.ndarray:
    """Expected counts [judge, true, given]; without a model by the items' shares of votes."""
    k = len(LABELS)
    logs = model.logs if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(judges * k * k)
        for batch in batches:
            if not batch.num_rows:
                continue
            j, given, starts = _votes(batch)
            n = np.diff(starts)
            if logs is None:
                shares = np.add.reduceat(np.eye(k)[given], starts[:-1], axis=0)
                post = (shares + 0.01) / (shares + 0.01).sum(axis=1, keepdims=True)
            else:
                post = posterior(j, given, starts, logs)
            each = np.repeat(post, n, axis=0)
            for t in range(k):
                total += np.bincount((j * k + t) * k + given, weights=each[:, t], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array((at // (k * k)).astype(np.int32)), pa.array((at // k % k).astype(np.int32)), pa.array((at % k).astype(np.int32)), pa.array(total[at])],
            names=["judge", "truth", "given", "mass"],
        )

    parts = packed.select("votes").mapInArrow(run, COUNTS)
    out = np.zeros((judges, k, k))
    for r in parts.groupBy("judge", "truth", "given").agg(F.sum("mass").alias("mass")).collect():
        out[r["judge"], r["truth"], r["given"]] = r["mass"]
    return out


def _model(names: list[str], counts: np.ndarray) -> Model:
    k = len(LABELS)
    # Smoothing: as if each judge had been seen a little more, in the manner of all judges together.
    pooled = counts.sum(axis=0) + SMOOTH
    pooled = pooled / pooled.sum(axis=1, keepdims=True)
    conf = counts + SMOOTH * k * pooled
    prior = counts.sum(axis=(0, 2)) + SMOOTH
    return Model(names, conf / conf.sum(axis=2, keepdims=True), prior / prior.sum())


def _fit_packed(packed: DataFrame, names: list[str]) -> Model:
    model = _model(names, _counts(packed, None, len(names)))
    for _ in range(STEPS):
        new = _model(names, _counts(packed, model, len(names)))
        change = float(np.abs(new.confusion - model.confusion).max())
        model = new
        if change < CLOSE:
            break
    return model


def pack(votes: DataFrame, names: list[str]) -> DataFrame:
    """item_id and votes (judge number times the number of labels, plus the label's) of each item."""
    spark = votes.sparkSession
    numbers = spark.createDataFrame(list(enumerate(names)), "n int, judge string")
    label = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label")) - 1
    # At most MANY names, so the table of numbers is small.
    rows = votes.join(F.broadcast(numbers), "judge").select("item_id", (F.col("n") * len(LABELS) + label).cast("int").alias("v"))
    return rows.groupBy("item_id").agg(F.sort_array(F.collect_list("v")).alias("votes"))


def consensus(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, n_votes, differ, label, certainty) of items, and (judge, truth, given, p, mass).

    ``label`` is the most probable true label; equal probabilities go to the first in LABELS. Items
    without a counting label are left out. An empty table gives two empty ones.
    """
    votes = cut(counting(verdicts), "votes")
    spark = verdicts.sparkSession
    some = votes.select("judge").distinct().limit(MANY + 1).collect()
    if len(some) > MANY:
        return _consensus_by_joins(votes)
    names = sorted(r[0] for r in some)
    packed = cut(pack(votes, names), "packed")
    if not names:
        return (
            spark.createDataFrame([], "item_id string, n_votes int, differ boolean, label string, certainty double"),
            spark.createDataFrame([], "judge string, truth string, given string, p double, mass double"),
        )
    model = _fit_packed(packed, names)
    mass = _counts(packed, model, len(names))
    logs = model.logs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            j, given, starts = _votes(batch)
            post = posterior(j, given, starts, logs)
            best = post.argmax(axis=1)
            differ = np.maximum.reduceat(given, starts[:-1]) != np.minimum.reduceat(given, starts[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(starts).astype(np.int32)), pa.array(differ), pa.array([LABELS[b] for b in best]), pa.array(post.max(axis=1))],
                names=["item_id", "n_votes", "differ", "label", "certainty"],
            )

    items = packed.mapInArrow(run, "item_id string, n_votes int, differ boolean, label string, certainty double")
    rows = [
        (n, LABELS[t], LABELS[g], float(model.confusion[j, t, g]), float(mass[j, t, g]))
        for j, n in enumerate(names)
        for t in range(len(LABELS))
        for g in range(len(LABELS))
    ]
    return items, spark.createDataFrame(rows, "judge string, truth string, given string, p double, mass double")


def _consensus_by_joins(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same estimate with the matrices in a table, for very many judges."""
    names = votes.sparkSession.createDataFrame([(x,) for x in LABELS], "truth string")
    share = votes.groupBy("item_id").pivot("label", list(LABELS)).count().na.fill(0)
    total = sum(F.col(x) + 0.01 for x in LABELS)
    post = share.select("item_id", F.explode(F.array(*[F.struct(F.lit(x).alias("truth"), ((F.col(x) + 0.01) / total).alias("q")) for x in LABELS])).alias("s"))
    post = cut(post.select("item_id", "s.truth", "s.q"), "post")
    model, change = None, None
    for _ in range(STEPS):
        counts = votes.join(post, "item_id").groupBy("judge", "truth", F.col("label").alias("given")).agg(F.sum("q").alias("mass"))
        full = votes.select("judge").distinct().join(F.broadcast(names)).join(F.broadcast(names.withColumnRenamed("truth", "given")))
        counts = full.join(counts, ["judge", "truth", "given"], "left").na.fill(0.0, ["mass"])
        pooled = counts.groupBy("truth", "given").agg((F.sum("mass") + SMOOTH).alias("all"))
        per_truth = pooled.groupBy("truth").agg(F.sum("all").alias("of_truth"))
        counts = counts.join(F.broadcast(pooled), ["truth", "given"]).join(F.broadcast(per_truth), "truth")
        counts = counts.withColumn("c", F.col("mass") + SMOOTH * len(LABELS) * F.col("all") / F.col("of_truth"))
        sums = counts.groupBy("judge", "truth").agg(F.sum("c").alias("s"))
        new = cut(counts.join(sums, ["judge", "truth"]).select("judge", "truth", "given", (F.col("c") / F.col("s")).alias("p"), "mass"), "model")
        prior = new.groupBy("truth").agg((F.sum("mass") + SMOOTH).alias("w"))
        score = votes.join(new, (votes["judge"] == new["judge"]) & (votes["label"] == new["given"])).groupBy("item_id", "truth").agg(F.sum(F.log("p")).alias("ll"))
        score = score.join(F.broadcast(prior), "truth").withColumn("ll", F.col("ll") + F.log("w"))
        top = score.groupBy("item_id").agg(F.max("ll").alias("top"))
        score = score.join(top, "item_id").withColumn("e", F.exp(F.col("ll") - F.col("top")))
        norm = score.groupBy("item_id").agg(F.sum("e").alias("z"))
        post = cut(score.join(norm, "item_id").select("item_id", "truth", (F.col("e") / F.col("z")).alias("q")), "post")
        if model is not None:
            old = model.select("judge", "truth", "given", F.col("p").alias("before"))
            change = new.join(old, ["judge", "truth", "given"]).agg(F.max(F.abs(F.col("p") - F.col("before")))).first()[0]
        model = new
        if change is not None and change < CLOSE:
            break
    best = post.groupBy("item_id").agg(F.max_by("truth", F.struct("q", -F.array_position(F.array(*map(F.lit, LABELS)), F.col("truth")))).alias("label"), F.max("q").alias("certainty"))
    about = votes.groupBy("item_id").agg(F.count(F.lit(1)).cast("int").alias("n_votes"), (F.min("label") != F.max("label")).alias("differ"))
    return best.join(about, "item_id").select("item_id", "n_votes", "differ", "label", "certainty"), model


_VOTES = r"""
v as (
  select item_id, regexp_replace(lower(judge), '[^\p{L}\p{N}]', '', 'g') as judge,
         regexp_replace(lower(label), '[^\p{L}\p{N}]', '', 'g') as l, judged_at, verdict_id
  from verdicts where item_id is not null and judge is not null and label is not null),
c as (
  select item_id, judge, judged_at, verdict_id,
         case when l like '%nothallucinated%' then 'NOT_HALLUCINATED' when l like '%invalid%' then 'INVALID'
              when l like '%hallucinated%' then 'HALLUCINATED' end as label
  from v where l not like '%unparseable%'),
n as materialized (
  select item_id, judge, label from c where label is not null
  qualify row_number() over (partition by item_id, judge order by judged_at desc nulls last, verdict_id desc nulls last, label desc) = 1)"""


def _sql_steps() -> str:
    """Expectation and maximisation, unrolled; q holds each item's chances of the three labels in their order."""
    t = range(len(LABELS))
    each = lambda f, sep=", ": sep.join(f.replace("$", str(k)) for k in t)
    parts = [
        "w as materialized (select item_id, judge, list_position([" + ", ".join(f"'{x}'" for x in LABELS) + "], label) - 1 as g from n)",
        "j as materialized (select judge, unnest([0, 1, 2]) as g from (select distinct judge from w))",
        "q0 as materialized (select item_id, " + each("(count(*) filter (where g = $) + 0.01e0) / (count(*) + 0.03e0) as q$") + " from w group by item_id)",
    ]
    for i in range(STEPS):
        parts += [
            f"k{i} as materialized (select judge, g, {each('sum(q$) as m$')} from (select judge, g, q0, q1, q2 from w join q{i} using (item_id) union all select judge, g, 0e0, 0e0, 0e0 from j) group by all)",
            f"o{i} as (select g, {each(f'(sum(m$) + {SMOOTH}e0) / sum(sum(m$) + {SMOOTH}e0) over () as p$')} from k{i} group by g)",
            f"d{i} as materialized (select judge, g, {each(f'ln((m$ + {3 * SMOOTH}e0 * p$) / sum(m$ + {3 * SMOOTH}e0 * p$) over (partition by judge)) as c$')} from k{i} join o{i} using (g))",
            f"r{i} as (select {each(f'ln((sum(m$) + {SMOOTH}e0) / (sum(m0) + sum(m1) + sum(m2) + {3 * SMOOTH}e0)) as a$')} from k{i})",
            f"s{i} as (select item_id, {each('sum(c$) + max(a$) as s$')} from w join d{i} using (judge, g), r{i} group by item_id)",
            f"q{i + 1} as materialized (select item_id, {each('exp(s$ - greatest(s0, s1, s2)) / (exp(s0 - greatest(s0, s1, s2)) + exp(s1 - greatest(s0, s1, s2)) + exp(s2 - greatest(s0, s1, s2))) as q$')} from s{i})",
        ]
    return ",\n".join(parts)


_FOUND = f"""with {_VOTES.strip()},
{_sql_steps()}
select item_id, case when q0 >= q1 and q0 >= q2 then '{LABELS[0]}' when q1 >= q2 then '{LABELS[1]}' else '{LABELS[2]}' end as label
from q{STEPS} where item_id in (select item_id from n group by item_id having min(label) <> max(label))"""


@LLM.query("p5_found", sql=_FOUND)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus label of every item whose counting labels differ."""
    items, _ = consensus(table(spark, sf_dir, "verdicts"))
    return items.filter("differ").select("item_id", "label")


@LLM.query("p5_items")
def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus, certainty and number of votes of every item."""
    return consensus(table(spark, sf_dir, "verdicts"))[0]


@LLM.query("p5_judges")
def p5_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each judge's reliability: the chance of giving the true label, by label and over all."""
    _, model = consensus(table(spark, sf_dir, "verdicts"))
    right = model.filter("truth = given")
    return model.groupBy("judge").agg(F.sum("mass").alias("n_labels")).join(
        right.groupBy("judge").agg(F.sum("mass").alias("right"), F.max(F.when(F.col("truth") == "HALLUCINATED", F.col("p"))).alias("p_hallucinated"), F.max(F.when(F.col("truth") == "NOT_HALLUCINATED", F.col("p"))).alias("p_not_hallucinated"), F.max(F.when(F.col("truth") == "INVALID", F.col("p"))).alias("p_invalid")),
        "judge",
    ).select("judge", "n_labels", (F.col("right") / F.col("n_labels")).alias("reliability"), "p_hallucinated", "p_not_hallucinated", "p_invalid")


_ALPHA = "with " + _VOTES.strip() + r""",
k as (select item_id, label, count(*) as k from n group by all),
m as (select item_id, sum(k) as m, sum(k * k) as sq from k group by all having sum(k) > 1),
g as (select label, sum(k) as g from k where item_id in (select item_id from m) group by all)
select (select count(*) from m) as n_items, (select cast(sum(m) as bigint) from m) as n_labels,
       (select sum((m * m - sq) / cast(m - 1 as double)) / sum(m) from m) as observed,
       (select (power(sum(g), 2) - sum(g * g)) / (sum(g) * (sum(g) - 1.0)) from g) as expected
"""


@LLM.query("p5_agreement", sql=f"select n_items, n_labels, round(observed, 9) as observed_disagreement, round(expected, 9) as expected_disagreement, round(1 - observed / expected, 9) as alpha from ({_ALPHA})")
def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance-corrected agreement of the counting labels (Krippendorff's alpha, nominal labels).

    Items with one counting label do not count; alpha is null if no disagreement is to be expected.
    """
    k = counting(table(spark, sf_dir, "verdicts")).groupBy("item_id", "label").agg(F.count(F.lit(1)).alias("k"))
    per = k.groupBy("item_id").agg(
        *[F.sum(F.when(F.col("label") == x, F.col("k")).otherwise(0)).alias(x) for x in LABELS], F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("sq")
    ).filter("m > 1")
    a = per.agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("m").alias("n_labels"),
        (F.sum((F.col("m") * F.col("m") - F.col("sq")).cast("double") / (F.col("m") - 1)) / F.sum("m")).alias("o"),
        *[F.sum(x).cast("double").alias(x) for x in LABELS],
    )
    n = sum(F.col(x) for x in LABELS)
    e = (n * n - sum(F.col(x) * F.col(x) for x in LABELS)) / F.nullif(n * (n - 1), F.lit(0.0))
    return a.select(
        "n_items", "n_labels", F.round("o", 9).alias("observed_disagreement"), F.round(e, 9).alias("expected_disagreement"), F.round(1 - F.col("o") / F.nullif(e, F.lit(0.0)), 9).alias("alpha")
    )
