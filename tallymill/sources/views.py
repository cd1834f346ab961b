"""The pipeline's records as the queries see them, in DataFrame form and as SQL for the comparison.

``predictions``  one row per run, item and method, cleaned (the table holds repeats and odd spellings)
``wide``         five methods' scores of every item, from the embedding table
``big``          three methods' scores over all line items, heavily tied, for the large operators
``votes``        the newest parsed label of each judge on each item
``attention``    causal attention weights of short token sequences, from the embedding table
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.sources.tables import table

METHODS = ("saplma", "lapeigvals", "icr", "attn_baseline", "svd_baseline")
WIDE_SETS = ("coqa", "nqopen", "squadv2", "triviaqa")
BIG_METHODS = ("discount", "tax", "quantity")


def plain_dataset(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[\s_-]", "")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows only (y 0 or 1); NaN scores become null; repeats collapse to their largest values."""
    t = table(spark, sf_dir, "predictions").filter(F.col("y").isin(0, 1) & F.col("item_id").isNotNull())
    score = F.when(~F.isnan("score"), F.col("score"))
    return t.groupBy("run", "seed", "fold", plain_dataset(F.col("dataset")).alias("dataset"), "item_id", "method").agg(
        F.max("group_id").alias("group_id"),
        F.max("y").cast("int").alias("y"),
        F.max(score).alias("score"),
        F.max("pred").cast("int").alias("pred"),
        F.max("threshold").alias("threshold"),
        F.max("source").alias("source"),
    )


SQL_PREDICTIONS = r"""
pred as (
  select run, seed, fold, regexp_replace(lower(dataset), '[\s_-]', '', 'g') as dataset, item_id, method,
         max(group_id) as group_id, max(y) as y, max(case when not isnan(score) then score end) as score,
         max(pred) as pred, max(threshold) as threshold, max(source) as source
  from predictions where y in (0, 1) and item_id is not null
  group by all)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    dataset = F.element_at(F.array(*[F.lit(x) for x in WIDE_SETS]), (F.col("vec_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("vec_id").alias("item_id"),
        dataset.alias("dataset"),
        F.concat(dataset, F.lit(":"), F.floor(F.col("vec_id") / 20).cast("string")).alias("group_id"),
        (F.col("label") < 3).cast("int").alias("y"),
        F.col("label").cast("int").alias("label"),
        *[F.element_at("embedding", k + 2).cast("double").alias(m) for k, m in enumerate(METHODS)],
    )


SQL_WIDE = """
wide as (
  select vec_id as item_id, %s[vec_id %% 4 + 1] as dataset, %s[vec_id %% 4 + 1] || ':' || cast(vec_id // 20 as varchar) as group_id,
         cast(label < 3 as int) as y, cast(label as int) as label,
         %s
  from embeddings)""" % (list(WIDE_SETS), list(WIDE_SETS), ", ".join(f"cast(embedding[{k + 2}] as double) as {m}" for k, m in enumerate(METHODS)))


def long(frame: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(…, method, score, pred) of a wide frame; a score of 0 or more is a positive decision."""
    keys = [c for c in frame.columns if c not in methods]
    return frame.unpivot(keys, list(methods), "method", "score").withColumn("pred", (F.col("score") >= 0).cast("int"))


SQL_LONG = SQL_WIDE + """,
emb as (
  select item_id, dataset, group_id, y, label, method, score, cast(score >= 0 as int) as pred
  from wide unpivot (score for method in (%s)))""" % ", ".join(METHODS)


def big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, group_id, y, method, score, pred) of all line items under three methods."""
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus", "l_returnflag", "l_discount", "l_tax", "l_quantity")
    base = t.select(
        F.col("l_linestatus").alias("dataset"),
        F.col("l_orderkey").alias("group_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_quantity") / 50.0).alias("quantity"),
    )
    cut = F.when(F.col("method") == "discount", 0.05).when(F.col("method") == "tax", 0.04).otherwise(0.5)
    return base.unpivot(["dataset", "group_id", "y"], list(BIG_METHODS), "method", "score").withColumn("pred", (F.col("score") >= cut).cast("int"))


SQL_BIG = """
bigwide as (
  select l_linestatus as dataset, l_orderkey as group_id, cast(l_returnflag = 'R' as int) as y,
         l_discount as discount, l_tax as tax, l_quantity / 50.0e0 as quantity from lineitem),
big as (
  select dataset, group_id, y, method, score,
         cast(score >= case method when 'discount' then 0.05e0 when 'tax' then 0.04e0 else 0.5e0 end as int) as pred
  from bigwide unpivot (score for method in (discount, tax, quantity)))"""


def parsed_label(c: Column) -> Column:
    """The label in a judge's text, whose order of tests matters: one name holds another."""
    s = F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), "[- ]", "_")
    return (
        F.when(s.contains("NOT_HALLUCINATED"), "NOT_HALLUCINATED").when(s.contains("INVALID"), "INVALID").when(s.contains("HALLUCINATED"), "HALLUCINATED").otherwise("UNPARSEABLE")
    )


SQL_PARSED = """case when {s} like '%NOT\\_HALLUCINATED%' escape '\\' then 'NOT_HALLUCINATED' when {s} like '%INVALID%' then 'INVALID'
  when {s} like '%HALLUCINATED%' then 'HALLUCINATED' else 'UNPARSEABLE' end"""


def sql_parsed(column: str) -> str:
    return SQL_PARSED.format(s=f"regexp_replace(upper(trim(coalesce({column}, ''))), '[- ]', '_', 'g')")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, judge, label) by the newest row; equal times go to the highest verdict_id."""
    v = table(spark, sf_dir, "verdicts", "verdict_id", "item_id", "judge", "label", "judged_at").filter("item_id is not null and judge is not null")
    judge = F.regexp_replace(F.lower(F.trim("judge")), "_", "-")
    return v.groupBy("item_id", judge.alias("judge")).agg(F.max_by(parsed_label(F.col("label")), F.struct("judged_at", "verdict_id")).alias("label"))


SQL_VOTES = f"""
votes as (
  select item_id, regexp_replace(lower(trim(judge)), '_', '-', 'g') as judge, {sql_parsed('label')} as label
  from verdicts where item_id is not null and judge is not null
  qualify row_number() over (partition by item_id, regexp_replace(lower(trim(judge)), '_', '-', 'g') order by judged_at desc nulls last, verdict_id desc) = 1)"""


def item_dataset(c: Column) -> Column:
    """The data set in an item's name."""
    return F.split_part(c, F.lit(":"), F.lit(1))


HEADS = 2
TOKENS = 10


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, head, i, j, a) with j <= i: each item is ten vectors, each head sees half of them.

    Weights are the absolute products of the two tokens' halves, made to add up to 1 in each row.
    """
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    x = e.select(F.floor(F.col("vec_id") / TOKENS).alias("item_id"), (F.col("vec_id") % TOKENS).cast("int").alias("i"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    pairs = x.alias("q").join(x.alias("k"), (F.col("q.item_id") == F.col("k.item_id")) & (F.col("k.i") <= F.col("q.i")))
    half = lambda c, h: F.slice(c, 1 + 32 * h, 32)
    w = lambda h: F.abs(F.aggregate(F.zip_with(half("q.x", h), half("k.x", h), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)) + 1e-3
    rows = pairs.select(F.col("q.item_id").alias("item_id"), F.col("q.i").alias("i"), F.col("k.i").alias("j"), F.array(*[w(h) for h in range(HEADS)]).alias("w"))
    rows = rows.select("item_id", "i", "j", F.posexplode("w").alias("head", "w"))
    total = rows.groupBy("item_id", "head", "i").agg(F.sum("w").alias("t"))
    return rows.join(total, ["item_id", "head", "i"]).select("item_id", "head", "i", "j", (F.col("w") / F.col("t")).alias("a"))


SQL_ATTENTION = """
tok as (select vec_id // 10 as item_id, cast(vec_id % 10 as int) as i, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings),
att0 as (select q.item_id, q.i, k.i as j, unnest([0, 1]) as head,
           unnest([abs(list_sum(list_transform(range(1, 33), lambda d: q.x[d] * k.x[d]))) + 1e-3,
                   abs(list_sum(list_transform(range(33, 65), lambda d: q.x[d] * k.x[d]))) + 1e-3]) as w
         from tok q join tok k on q.item_id = k.item_id and k.i <= q.i),
att as (select item_id, head, i, j, w / sum(w) over (partition by item_id, head, i) as a from att0)"""
