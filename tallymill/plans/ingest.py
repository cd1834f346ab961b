"""From raw records to labelled items: sources, logs, labels, prompts, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.functions import expressions as X
from tallymill.functions import named
from tallymill.functions import prompts as T
from tallymill.functions import sqltext as S
from tallymill.functions.expressions import order_hash, out
from tallymill.operators import ranked as R
from tallymill.operators import records
from tallymill.plans.agreement import SQL_MAJORITY, majority
from tallymill.plans.features import usable
from tallymill.registry import CORE
from tallymill.sources import views as V
from tallymill.sources.tables import table

q = CORE.query


@q(
    "src_dedup_alias",
    sql="""with r as (select item_id, question, gold_answers, loaded_at, coalesce(group_id, '') as g from items where item_id is not null),
      l as (select item_id, arg_max(question, struct_pack(t := loaded_at, q := question, n := len(gold_answers), g := g)) as question,
              arg_max(gold_answers[1], struct_pack(t := loaded_at, q := question, n := len(gold_answers), g := g)) as canonical from r group by all),
      a as (select item_id, list_sort(list_distinct(flatten(list(gold_answers)))) as every from r group by all)
      select item_id, question, case when canonical is null then every else list_concat([canonical], list_filter(every, lambda x: x <> canonical)) end as answers
      from l join a using (item_id)""",
)
def src_dedup_alias(spark: SparkSession, d: str) -> DataFrame:
    """One row per item: the last load's question and first answer, then all other answers in order."""
    r = table(spark, d, "items", "item_id", "question", "gold_answers", "loaded_at", "group_id").filter("item_id is not null")
    order = F.struct("loaded_at", "question", F.size("gold_answers"), F.coalesce("group_id", F.lit("")))
    last = r.groupBy("item_id").agg(F.max_by("question", order).alias("question"), F.max_by(F.get("gold_answers", F.lit(0)), order).alias("canonical"))
    every = r.select("item_id", F.explode_outer("gold_answers").alias("g")).groupBy("item_id").agg(F.sort_array(F.collect_set("g")).alias("every"))
    answers = F.when(F.col("canonical").isNull(), F.col("every")).otherwise(F.concat(F.array("canonical"), F.array_remove("every", F.col("canonical"))))
    return last.join(every, "item_id").select("item_id", "question", answers.alias("answers"))


@q("src_row_index", sql="with i as (select distinct item_id from items where item_id is not null) select item_id, 'row:' || (row_number() over (partition by split_part(item_id, ':', 1) order by item_id) - 1) as row_id from i")
def src_row_index(spark: SparkSession, d: str) -> DataFrame:
    """Rows numbered from 0 within their data set in the order of their key."""
    i = table(spark, d, "items", "item_id").filter("item_id is not null").distinct()
    n = R.numbers(i.withColumn("dataset", V.item_dataset(F.col("item_id"))), ["dataset"], "item_id", "n")
    return n.select("item_id", F.concat(F.lit("row:"), F.col("n").cast("string")).alias("row_id"))


@q(
    "src_hash_group",
    sql="""with r as (select distinct item_id, context, list_sort(list_distinct(gold_answers)) as golds from items where item_id is not null and len(gold_answers) > 0)
      select item_id, golds, case when context is null then item_id else split_part(item_id, ':', 1) || ':' || substr(sha1(context), 1, 16) end as group_id from r""",
)
def src_hash_group(spark: SparkSession, d: str) -> DataFrame:
    """Answerable rows with distinct sorted answers, grouped by a hash of their context."""
    r = table(spark, d, "items", "item_id", "context", "gold_answers").filter((F.size("gold_answers") > 0) & F.col("item_id").isNotNull())
    r = r.select("item_id", "context", F.array_sort(F.array_distinct("gold_answers")).alias("golds")).distinct()
    g = F.when(F.col("context").isNull(), F.col("item_id")).otherwise(F.concat(V.item_dataset(F.col("item_id")), F.lit(":"), F.substring(F.sha1(F.col("context").cast("binary")), 1, 16)))
    return r.select("item_id", "golds", g.alias("group_id"))


_TURNS = """t as (select meta['conversation'] as conversation, cast(meta['turn'] as int) as turn, min(question) as question, coalesce(min(gold_answers[1]), '') as answer
  from items where item_id like 'coqa:%' and meta['conversation'] is not null and meta['turn'] is not null group by all)"""


@q(
    "src_turn_history",
    sql=S.with_(_TURNS) + """select conversation, turn, question,
      coalesce(string_agg('Q: ' || question || chr(10) || 'A: ' || answer, chr(10)) over (partition by conversation order by turn rows between unbounded preceding and 1 preceding), '') as history from t""",
)
def src_turn_history(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations, each with the questions and answers before it."""
    i = table(spark, d, "items", "item_id", "question", "gold_answers", "meta").filter(F.col("item_id").startswith("coqa:"))
    t = i.select(F.col("meta")["conversation"].alias("conversation"), F.col("meta")["turn"].cast("int").alias("turn"), "question", F.get("gold_answers", F.lit(0)).alias("a"))
    t = t.filter("conversation is not null and turn is not null").groupBy("conversation", "turn").agg(F.min("question").alias("question"), F.coalesce(F.min("a"), F.lit("")).alias("answer"))
    line = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer")
    before = Window.partitionBy("conversation").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("conversation", "turn", "question", F.array_join(F.collect_list(line).over(before), "\n").alias("history"))


@q(
    "log_last_wins",
    sql="select user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) as event_type, round(arg_max(value, struct_pack(t := ts, e := event_id)), 9) as value, arg_max(event_id, struct_pack(t := ts, e := event_id)) as event_id, count(*) as n_records from events group by all",
)
def log_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each id in an append-only log."""
    e = table(spark, d, "events", "user_id", "event_type", "value", "event_id", "ts")
    order = F.struct("ts", "event_id")
    best = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value", "event_id"), order).alias("r"), F.count(F.lit(1)).alias("n_records"))
    return best.select("user_id", "r.event_type", out(F.col("r.value")).alias("value"), "r.event_id", "n_records")


@q("resume_anti_join", sql="select distinct item_id from items where item_id is not null and item_id not in (select item_id from answers where item_id is not null)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Items that have no answer yet."""
    return records.pending(table(spark, d, "items", "item_id").filter("item_id is not null").distinct(), table(spark, d, "answers", "item_id"), "item_id")


_USABLE = "len(hidden_states) = 64 and len(list_filter(hidden_states, lambda v: v is not null and isfinite(v))) = 64"


@q(
    "feature_scan",
    sql=S.with_(SQL_MAJORITY, f"f as (select item_id, i, coalesce(extracted_at, timestamp '0001-01-01') as t, list_transform(hidden_states, lambda v: round(cast(v as double), 6)) as x from forward_traces where layer = 20 and {_USABLE} and item_id in (select item_id from lab where scored))")
    + "select item_id, i, arg_max(x, struct_pack(t := t, x := x)) as x from f group by all",
)
def feature_scan(spark: SparkSession, d: str) -> DataFrame:
    """One block of features of the scored items only: pruned columns, a pushed filter, a semi join."""
    lab = majority(V.votes(spark, d)).filter("scored").select("item_id")
    return scan_features(table(spark, d, "forward_traces", "item_id", "layer", "i", "hidden_states", "extracted_at"), lab, 20)


def scan_features(traces: DataFrame, wanted: DataFrame, layer: int, required: bool = False) -> DataFrame:
    """(item_id, i, x) of the wanted items' newest usable vectors; ``required`` raises if an item has none."""
    f = usable(traces.filter(F.col("layer") == layer)).join(wanted.select("item_id"), "item_id", "left_semi")
    f = f.select("item_id", "i", F.coalesce("extracted_at", F.lit("0001-01-01").cast("timestamp")).alias("t"), F.transform("hidden_states", lambda v: F.round(v.cast("double"), 6)).alias("x"))
    out_ = f.groupBy("item_id", "i").agg(F.max_by("x", F.struct("t", "x")).alias("x"))
    if required:
        records.require_all(wanted, out_, "item_id")
    return out_


@q(
    "block_rows",
    sql=f"with a as (select distinct item_id from answers where item_id is not null), f as (select item_id, layer, coalesce(extracted_at, timestamp '0001-01-01') as t, list_transform(hidden_states, lambda v: round(cast(v as double), 6)) as x from forward_traces where i = seq_len - 1 and {_USABLE}), b as (select item_id, arg_max(x, struct_pack(t := t, x := x)) filter (where layer = 20) as x20, arg_max(x, struct_pack(t := t, x := x)) filter (where layer = 40) as x40 from f group by all) select a.item_id, x20, x40, (x20 is null)::int + (x40 is null)::int as n_missing from a left join b using (item_id)",
)
def block_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two blocks of features beside each other in a row per answered item; a missing block stays null and is never filled with zeros."""
    a = table(spark, d, "answers", "item_id").filter("item_id is not null").distinct()
    f = usable(table(spark, d, "forward_traces", "item_id", "layer", "i", "seq_len", "hidden_states", "extracted_at").filter((F.col("i") == F.col("seq_len") - 1) & F.col("layer").isin(20, 40)))
    f = f.select("item_id", "layer", F.struct(F.coalesce("extracted_at", F.lit("0001-01-01").cast("timestamp")).alias("t"), F.transform("hidden_states", lambda v: F.round(v.cast("double"), 6)).alias("x")).alias("r"))
    b = f.groupBy("item_id").agg(*[F.max(F.when(F.col("layer") == k, F.col("r"))).alias(f"r{k}") for k in (20, 40)])
    b = a.join(b, "item_id", "left").select("item_id", F.col("r20.x").alias("x20"), F.col("r40.x").alias("x40"))
    return b.withColumn("n_missing", F.col("x20").isNull().cast("int") + F.col("x40").isNull().cast("int"))


@q("unpivot_predictions", sql=S.with_(V.SQL_LONG) + "select item_id, y, method, round(score, 9) as score, pred from emb")
def unpivot_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Wide scores to one row per method."""
    return V.long(V.wide(spark, d)).select("item_id", "y", "method", out("score").alias("score"), "pred")


@q(
    "pivot_predictions",
    sql=S.with_(V.SQL_PREDICTIONS) + "select run, seed, item_id, y, " + ", ".join(f"max(score) filter (where method = '{m}') as scores_{m}, max(pred) filter (where method = '{m}') as preds_{m}" for m in ("saplma", "lapeigvals", "icr", "charm", "union_equal")) + " from pred group by all",
)
def pivot_predictions(spark: SparkSession, d: str) -> DataFrame:
    """One row per item with every method's score and decision; the values of the pivot are given, so one pass."""
    names = ["saplma", "lapeigvals", "icr", "charm", "union_equal"]
    p = V.predictions(spark, d).groupBy("run", "seed", "item_id", "y").pivot("method", names).agg(F.max("score").alias("s"), F.max("pred").alias("p"))
    return p.select("run", "seed", "item_id", "y", *[F.col(f"{m}_{a}").alias(f"{b}_{m}") for m in names for a, b in (("s", "scores"), ("p", "preds"))])


@q(
    "draw_fingerprint",
    sql=S.with_(V.SQL_PREDICTIONS, "i as (select distinct run, seed, item_id, y from pred)") + "select run, seed, count(*) as n, cast(sum(cast(('0x' || substr(md5(item_id || '=' || y), 1, 12)) as bigint)) as varchar) as fingerprint from i group by all",
)
def draw_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint of each draw's ids and labels, whatever their order: a sum of hashes, so no draw is gathered."""
    i = V.predictions(spark, d).select("run", "seed", "item_id", "y").distinct()
    h = F.conv(F.substring(F.md5(F.concat("item_id", F.lit("="), F.col("y").cast("string"))), 1, 12), 16, 10).cast("decimal(20,0)")
    return i.groupBy("run", "seed").agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("decimal(38,0)").cast("string").alias("fingerprint"))


@q(
    "union_parts",
    sql=S.with_(V.SQL_PREDICTIONS, "p as (select run, method, count(*) as n, 0 as part from pred where seed <= 3 group by all union all select run, method, count(*), 1 from pred where seed >= 3 group by all)") + "select run, method, arg_max(n, part) as n from p group by all",
)
def union_parts(spark: SparkSession, d: str) -> DataFrame:
    """Result parts of two invocations put together; the later one wins."""
    p = V.predictions(spark, d)
    parts = [p.filter(c).groupBy("run", "method").agg(F.count(F.lit(1)).alias("n")) for c in ("seed <= 3", "seed >= 3")]
    return records.union_parts(parts, ["run", "method"])


@q(
    "load_scored",
    sql=S.with_(SQL_MAJORITY) + "select item_id, cast(label = 'HALLUCINATED' as int) as y, n_agreeing from lab where scored and item_id in (select item_id from answers)",
)
def load_scored(spark: SparkSession, d: str) -> DataFrame:
    """Scored labels of items that have an answer, as 0 and 1."""
    lab = majority(V.votes(spark, d)).filter("scored").join(table(spark, d, "answers", "item_id"), "item_id", "left_semi")
    return lab.select("item_id", (F.col("label") == "HALLUCINATED").cast("int").alias("y"), "n_agreeing")


@q(
    "item_metadata",
    sql=S.with_(SQL_MAJORITY, "a as (select item_id, max(answer_tokens) as answer_tokens, max(prompt_tokens) as prompt_tokens, max(len(gold_answers)) as n_gold from answers group by all)")
    + "select a.item_id, cast(answer_tokens as int) as answer_tokens, cast(prompt_tokens as int) as prompt_tokens, cast(n_gold as int) as n_gold, l.unanimous, l.n_judges from a left join lab l using (item_id)",
)
def item_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, reference answers and the judges' unanimity of each answered item."""
    a = table(spark, d, "answers", "item_id", "answer_tokens", "prompt_tokens", "gold_answers").groupBy("item_id")
    a = a.agg(F.max("answer_tokens").alias("answer_tokens"), F.max("prompt_tokens").alias("prompt_tokens"), F.max(F.size("gold_answers")).alias("n_gold"))
    return a.join(majority(V.votes(spark, d)).select("item_id", "unanimous", "n_judges"), "item_id", "left")


_AUDIT = """
au as (select run || '|' || item_id as k, dataset, case when pred = 1 then 'fp' else 'fn' end as error_type, score from pred where method = 'saplma' and pred <> y),
bl as (select k, case when md5('verdict:' || k) < '8' then 'wrong' else 'right' end as verdict, case when md5('flag:' || k) < '2' then 'unsure' end as flag from au),
aj as (select au.k, dataset, error_type, verdict, flag, l.unanimous from au join bl using (k) left join lab l on l.item_id = substr(au.k, instr(au.k, '|') + 1))"""


def _audit(spark: SparkSession, d: str) -> DataFrame:
    """The key of the audited errors joined with a reviewer's verdicts (dealt by hash)."""
    p = V.predictions(spark, d).filter("method = 'saplma' and pred <> y")
    key = p.select(F.concat_ws("|", "run", "item_id").alias("k"), "item_id", "dataset", F.when(F.col("pred") == 1, "fp").otherwise("fn").alias("error_type"))
    blind = key.select("k", F.when(order_hash(F.lit("verdict"), "k") < "8", "wrong").otherwise("right").alias("verdict"), F.when(order_hash(F.lit("flag"), "k") < "2", "unsure").alias("flag"))
    lab = majority(V.votes(spark, d)).select("item_id", "unanimous")
    return key.join(blind, "k").join(lab, "item_id", "left").select("k", "dataset", "error_type", "verdict", "flag", "unanimous")


@q("audit_join", sql=S.with_(V.SQL_PREDICTIONS, SQL_MAJORITY, _AUDIT) + "select k, dataset, error_type, verdict, flag, unanimous from aj")
def audit_join(spark: SparkSession, d: str) -> DataFrame:
    """Blind verdicts joined with the answer key."""
    return _audit(spark, d)


@q(
    "audit_crosstab",
    sql=S.with_(V.SQL_PREDICTIONS, SQL_MAJORITY, _AUDIT, "c as (select verdict, unnest([{'dim': 'dataset', 'value': dataset}, {'dim': 'error_type', 'value': error_type}, {'dim': 'flag', 'value': coalesce(flag, 'none')}, {'dim': 'unanimous', 'value': coalesce(cast(unanimous as varchar), 'unknown')}], recursive := true) from aj)")
    + "select dim, value, count(*) as n, count(*) filter (where verdict = 'wrong') as n_wrong, round(avg(cast(verdict = 'wrong' as int)), 9) as wrong_rate from c group by all",
)
def audit_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts by data set, kind of error, flag and unanimity: one pass over unpivoted dimensions."""
    a = _audit(spark, d).select("verdict", "dataset", "error_type", F.coalesce("flag", F.lit("none")).alias("flag"), F.coalesce(F.col("unanimous").cast("string"), F.lit("unknown")).alias("unanimous"))
    c = a.unpivot(["verdict"], ["dataset", "error_type", "flag", "unanimous"], "dim", "value")
    wrong = F.col("verdict") == "wrong"
    return c.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"), X.count_if(wrong).alias("n_wrong"), out(F.avg(wrong.cast("int"))).alias("wrong_rate"))


_RUN_METHODS = ("saplma", "lapeigvals", "icr", "charm", "union_equal")


@q(
    "master_table",
    sql=S.with_(V.SQL_PREDICTIONS, "g as (select run, dataset, unnest(['saplma', 'lapeigvals', 'icr', 'charm', 'union_equal']) as method from (select distinct run, dataset from pred))", f"c as (select run, dataset, method, {S.confusion()}, count(*) as n, count(pred) as n_dec, min(y) <> max(y) as two from pred group by all)")
    + f"select run, dataset, g.method, case when n is null then 'not run' when n_dec = 0 or not two then 'failed' else 'ok' end as status, coalesce(n, 0) as n, round(case when n_dec > 0 and two then {S.mcc()} end, 9) as mcc from g left join c using (run, dataset, method)",
)
def master_table(spark: SparkSession, d: str) -> DataFrame:
    """Every run, data set and method, with what is missing said as such."""
    p = V.predictions(spark, d)
    grid = p.select("run", "dataset").distinct().withColumn("method", F.explode(F.array(*[F.lit(m) for m in _RUN_METHODS])))
    c = p.groupBy("run", "dataset", "method").agg(*X.confusion(), F.count(F.lit(1)).alias("n"), F.count("pred").alias("n_dec"), (F.min("y") != F.max("y")).alias("two"))
    j = grid.join(c, ["run", "dataset", "method"], "left")
    ok = (F.col("n_dec") > 0) & F.col("two")
    status = F.when(F.col("n").isNull(), "not run").when((F.col("n_dec") == 0) | ~F.col("two"), "failed").otherwise("ok")
    return j.select("run", "dataset", "method", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), out(F.when(ok, X.mcc())).alias("mcc"))


@q(
    "extract_summary",
    sql="select split_part(item_id, ':', 1) as dataset, count(*) as n, round(avg(cast(lower(finish_reason) = 'length' as int)), 9) as truncated_rate, round(avg(cast(answer_tokens as double)), 9) as mean_tokens, round(avg(cast(seq_len as double)), 9) as mean_seq_len, round(sum(seconds), 6) as seconds from (select distinct gen_id, item_id, finish_reason, answer_tokens, seq_len, seconds from answers) group by all",
)
def extract_summary(spark: SparkSession, d: str) -> DataFrame:
    """Truncation, lengths and time of the generations by data set; repeats count once."""
    a = table(spark, d, "answers", "gen_id", "item_id", "finish_reason", "answer_tokens", "seq_len", "seconds").distinct()
    mean = lambda c: out(F.avg(F.col(c).cast("double")))
    return a.groupBy(V.item_dataset(F.col("item_id")).alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"), out(F.avg((F.lower("finish_reason") == "length").cast("int"))).alias("truncated_rate"), mean("answer_tokens").alias("mean_tokens"), mean("seq_len").alias("mean_seq_len"), F.round(F.sum("seconds"), 6).alias("seconds")
    )


@q(
    "collapse_rate",
    sql="with k as (select item_id, count(distinct gen_id) as k, count(distinct coalesce(answer, '')) as texts from answers where item_id is not null group by all) select k as n_samples, count(*) as n_items, round(avg(cast(texts = 1 as int)), 9) as collapse_rate from k where k > 1 group by all",
)
def collapse_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of items whose samples all have one text, by the number of samples."""
    k = table(spark, d, "answers", "item_id", "gen_id", "answer").filter("item_id is not null").groupBy("item_id").agg(F.count_distinct("gen_id").alias("n_samples"), F.count_distinct(F.coalesce("answer", F.lit(""))).alias("texts")).filter("n_samples > 1")
    return k.groupBy("n_samples").agg(F.count(F.lit(1)).alias("n_items"), out(F.avg((F.col("texts") == 1).cast("int"))).alias("collapse_rate"))


@q("parse_label", sql=f"select verdict_id, {V.sql_parsed('raw')} as label, left(raw, 200) as raw from verdicts")
def parse_label(spark: SparkSession, d: str) -> DataFrame:
    """The label in each judge's raw text, and the text's first 200 characters."""
    v = table(spark, d, "verdicts", "verdict_id", "raw")
    return v.select("verdict_id", V.parsed_label(F.col("raw")).alias("label"), F.substring("raw", 1, 200).alias("raw"))


@q("slug", sql="select distinct judge, regexp_replace(regexp_replace(lower(judge), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from verdicts")
def slug(spark: SparkSession, d: str) -> DataFrame:
    """File-name forms of the judges' names."""
    return table(spark, d, "verdicts", "judge").distinct().select("judge", T.slug(F.col("judge")).alias("slug"))


_STRIP = lambda c: f"regexp_replace({c}, '^{T.WHITE}+|{T.WHITE}+$', '', 'g')"
_GOLD = f"case when coalesce(len(gold_answers), 0) > 0 then array_to_string(gold_answers[1:{T.MAX_GOLDS}], '; ') else '{T.NO_GOLDS}' end"
_JUDGE = T.sql_fill(T.JUDGE_TEXT, question="question", gold=_GOLD, answer=f"coalesce(nullif({_STRIP('answer')}, ''), '{T.NO_ANSWER}')")


@q("judge_prompt", sql=f"select gen_id, md5({T.sql_fill(T.JUDGE_SYSTEM)}) as system, md5({_JUDGE}) as prompt from answers")
def judge_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The judge's messages for every generation (their hashes)."""
    a = table(spark, d, "answers", "gen_id", "question", "gold_answers", "answer")
    return a.select("gen_id", F.md5(F.lit(T.JUDGE_SYSTEM)).alias("system"), F.md5(T.judge_prompt(F.col("question"), F.col("gold_answers"), F.col("answer"))).alias("prompt"))


def _sql_by_context(plain: str, passage: str) -> str:
    return f"md5(case when coalesce(length(context), 0) > 0 then {T.sql_fill(passage, context='context', question='question')} else {T.sql_fill(plain, question='question')} end)"


@q("generator_prompt", sql=f"select item_id, md5({T.sql_fill(T.CHAT_SYSTEM)}) as system, {_sql_by_context(T.CHAT_PLAIN, T.CHAT_PASSAGE)} as chat, {_sql_by_context(T.SHOT_PLAIN, T.SHOT_PASSAGE)} as few_shot from items")
def generator_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The generator's messages for every item, and its few-shot form, with the passage if there is one (their hashes)."""
    i = table(spark, d, "items", "item_id", "question", "context")
    forms = {"chat": T.chat_prompt, "few_shot": T.few_shot_prompt}
    return i.select("item_id", F.md5(F.lit(T.CHAT_SYSTEM)).alias("system"), *[F.md5(f(F.col("question"), F.col("context"))).alias(k) for k, f in forms.items()])


_STOPS = "least(" + ", ".join(f"nullif(instr(t, {m}), 0)" for m in ("chr(10) || 'Q:'", "chr(10) || 'Passage:'", "chr(10) || chr(10)")) + ")"


@q("trim_completion", sql=f"with x as (select doc_id, text as t from documents where text is not null), y as (select doc_id, t, {_STOPS} as p from x) select doc_id, md5({_STRIP('case when p is null then t else substr(t, 1, p - 1) end')}) as completion from y")
def trim_completion(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut before the first stop marker (their hash)."""
    t = table(spark, d, "documents", "doc_id", "text").filter("text is not null")
    return t.select("doc_id", F.md5(T.trim_completion(F.col("text"))).alias("completion"))


@q(
    "feature_keys",
    sql="with k as (select distinct item_id || '/' || unnest(map_keys(feature_shapes)) as key, unnest(map_values(feature_shapes)) as shape from answers) select key, regexp_extract(key, '^(.*)/[^/]*$', 1, 's') as item_id, regexp_extract(key, '([^/]*)$', 1) as block, cast(list_product(shape) as bigint) as width from k where key is not null",
)
def feature_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of stored blocks with item and block (split at the last slash) and the number of values in each."""
    k = table(spark, d, "answers", "item_id", "feature_shapes").select("item_id", F.explode("feature_shapes").alias("b", "shape")).select(F.concat("item_id", F.lit("/"), "b").alias("key"), "shape").filter("key is not null").distinct()
    item, block = T.split_key(F.col("key"))
    return k.select("key", item.alias("item_id"), block.alias("block"), F.aggregate("shape", F.lit(1).cast("long"), lambda a, v: a * v).alias("width"))


@q("json_explode", sql="with j as (select event_id, event_type, unnest(json_keys(props)) as key, props from events) select event_type, key, count(*) as n, cast(sum(cast(json_extract_string(props, '$.' || key) as bigint)) as bigint) as total from j group by all")
def json_explode(spark: SparkSession, d: str) -> DataFrame:
    """Keys and values of a JSON column, added up by type."""
    e = table(spark, d, "events", "event_type", "props").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return e.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@q(
    "quality_gate",
    sql=S.with_(SQL_MAJORITY, "a as (select split_part(item_id, ':', 1) as dataset, count(distinct item_id) as n_answered from answers group by all)", "l as (select split_part(item_id, ':', 1) as dataset, count(*) as n_labelled, avg(cast(scored as int)) as scored_rate from lab group by all)")
    + "select dataset, n_answered, coalesce(n_labelled, 0) as n_labelled, round(scored_rate, 9) as scored_rate, coalesce(n_labelled, 0) >= 0.5e0 * n_answered and coalesce(scored_rate, 0) >= 0.6e0 as passed from a left join l using (dataset)",
)
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether enough answers of a data set are labelled and scored for the next stage."""
    a = table(spark, d, "answers", "item_id").distinct().groupBy(V.item_dataset(F.col("item_id")).alias("dataset")).agg(F.count(F.lit(1)).alias("n_answered"))
    lab = majority(V.votes(spark, d)).groupBy(V.item_dataset(F.col("item_id")).alias("dataset")).agg(F.count(F.lit(1)).alias("n_labelled"), F.avg(F.col("scored").cast("int")).alias("r"))
    j = a.join(lab, "dataset", "left").withColumn("n_labelled", F.coalesce("n_labelled", F.lit(0)))
    return j.select("dataset", "n_answered", "n_labelled", out("r").alias("scored_rate"), ((F.col("n_labelled") >= 0.5 * F.col("n_answered")) & (F.coalesce("r", F.lit(0.0)) >= 0.6)).alias("passed"))


@q(
    "edge_batches",
    sql="""with recursive a as (select distinct shard, gen_id, seq_len from answers where shard is not null and gen_id is not null and seq_len is not null),
      o as (select *, row_number() over (partition by shard order by gen_id) as k from a),
      b as (select shard, gen_id, k, 0 as batch, 1 as n, cast(seq_len as bigint) as total from o where k = 1
            union all
            select o.shard, o.gen_id, o.k, b.batch + case when b.n >= 64 or b.total + o.seq_len > 8000 then 1 else 0 end,
              case when b.n >= 64 or b.total + o.seq_len > 8000 then 1 else b.n + 1 end, case when b.n >= 64 or b.total + o.seq_len > 8000 then o.seq_len else b.total + o.seq_len end
            from b join o on o.shard = b.shard and o.k = b.k + 1)
      select shard, gen_id, cast(batch as int) as batch from b""",
)
def edge_batches(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a shard in batches of at most 64 items and 8,000 positions."""
    a = table(spark, d, "answers", "shard", "gen_id", "seq_len").distinct().filter("shard is not null and gen_id is not null and seq_len is not null")
    return records.batches(a, "gen_id", "seq_len", "shard", 64, 8000)


_W = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_INVALID = f"aw = '' or regexp_matches(aw, '{named.DECLINES}')"
_RIGHT = {
    "exact": "len(list_filter(gw, lambda g: g <> '' and g = aw)) > 0",
    "contains": "len(list_filter(gw, lambda g: g <> '' and contains(' ' || aw || ' ', ' ' || g || ' '))) > 0",
    "overlap": "list_max(list_transform(gw, lambda g: case when g = '' then 0e0 else 2e0 * len(list_intersect(list_distinct(string_split(aw, ' ')), list_distinct(string_split(g, ' ')))) / (len(list_distinct(string_split(aw, ' '))) + len(list_distinct(string_split(g, ' ')))) end)) >= 0.5e0",
}


@q(
    "judge_rules",
    sql=f"with w as (select distinct gen_id, {_W('answer')} as aw, gold_answers, list_transform(gold_answers, lambda g: {_W('g')}) as gw from answers where gen_id is not null), j as ("
    + " union all ".join(f"select gen_id, '{k}' as judge, case when {_INVALID} then 'INVALID' when coalesce(len(gold_answers), 0) = 0 then 'UNPARSEABLE' when {c} then 'NOT_HALLUCINATED' else 'HALLUCINATED' end as label from w" for k, c in _RIGHT.items())
    + ") select distinct gen_id, judge, label from j",
)
def judge_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every generation judged by the named rules: an equal answer, one that holds a reference, one that shares half its words."""
    named.install(spark)
    a = table(spark, d, "answers", "gen_id", "answer", "gold_answers").filter("gen_id is not null")
    return named.judged(a, "gen_id", "answer", "gold_answers", list(_RIGHT)).distinct()


_N = "sqrt(list_sum(list_transform(x, lambda v: v * v)))"
_BLOCKS = {
    "norm": f"[{_N}]",
    "top": "list_reverse_sort(x)[1:10]",
    "moments": "[list_sum(x) / len(x), list_sum(list_transform(x, lambda v: v * v)) / len(x), list_min(x), list_max(x)]",
    "softmax_entropy": "[ln(list_sum(list_transform(x, lambda v: exp(v - mx)))) - list_sum(list_transform(x, lambda v: (v - mx) * exp(v - mx))) / list_sum(list_transform(x, lambda v: exp(v - mx)))]",
}


@q(
    "extract_blocks",
    sql="with e as (select vec_id, list_transform(embedding, lambda v: cast(v as double)) as x, cast(list_max(embedding) as double) as mx from embeddings), b as (" + " union all ".join(f"select vec_id, '{k}' as block, {c} as v from e" for k, c in _BLOCKS.items()) + ") select vec_id, block, list_transform(v, lambda z: round(z, 6)) as values from b",
)
def extract_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every named extractor on every vector."""
    named.install(spark)
    b = named.extracted(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", list(_BLOCKS))
    return b.select("vec_id", "block", F.transform("values", lambda v: F.round(v, 6)).alias("values"))
