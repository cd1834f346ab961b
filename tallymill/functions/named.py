"""Named SQL functions: what a user picks by name to read sources, judge answers and extract features.

Every entry is SQL text, so Catalyst inlines it and nothing leaves the JVM. ``install`` makes the
entries temporary functions of a session, for SQL and for ``F.call_function`` alike; a user adds
entries of the same form. Models' own judges and extractors are run elsewhere: their raw texts and
traces are input tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The labels, and what an answer says that gives none.
LABELS = ("HALLUCINATED", "NOT_HALLUCINATED", "INVALID", "UNPARSEABLE")
DECLINES = r"^(?:i do not know|i don t know|i dont know|unknown|no idea|i cannot answer|i can t answer)\b"


@dataclass(frozen=True)
class Entry:
    """Parameters and result in SQL's types, and the body."""

    takes: str
    gives: str
    body: str


def _words(c: str) -> str:
    """The words of a text in small letters, with a space between."""
    return rf"trim(regexp_replace(lower(coalesce({c}, '')), r'[^\p{{L}}\p{{N}}]+', ' '))"


_A, _G = _words("answer"), _words("g")
_SAME = f"exists(golds, g -> {_G} <> '' AND {{test}})"
_VERDICT = f"CASE WHEN {_A} = '' OR {_A} RLIKE r'{DECLINES}' THEN 'INVALID' WHEN coalesce(size(golds), 0) = 0 THEN 'UNPARSEABLE' WHEN {{right}} THEN 'NOT_HALLUCINATED' ELSE 'HALLUCINATED' END"
_F1 = f"""transform(golds, g -> CASE WHEN {_G} = '' THEN 0D ELSE 2D * size(array_intersect(split({_A}, ' '), split({_G}, ' ')))
  / (size(array_distinct(split({_A}, ' '))) + size(array_distinct(split({_G}, ' ')))) END)"""


def _verdict(right: str) -> str:
    return _VERDICT.replace("{right}", right)


# Judges take an answer and its reference answers and give one of LABELS.
JUDGES = {
    "exact": Entry("answer STRING, golds ARRAY<STRING>", "STRING", _verdict(_SAME.replace("{test}", f"{_G} = {_A}"))),
    "contains": Entry("answer STRING, golds ARRAY<STRING>", "STRING", _verdict(_SAME.replace("{test}", f"contains(concat(' ', {_A}, ' '), concat(' ', {_G}, ' '))"))),
    "overlap": Entry("answer STRING, golds ARRAY<STRING>", "STRING", _verdict(f"array_max({_F1}) >= 0.5D")),
}

# Extractors take an array of numbers and give one.
_SUM = "aggregate({x}, 0D, (s, v) -> s + v)"
FEATURES = {
    "norm": Entry("x ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "array(sqrt(" + _SUM.format(x="transform(x, v -> v * v)") + "))"),
    "top": Entry("x ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "slice(sort_array(x, false), 1, 10)"),
    "moments": Entry("x ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "array(" + _SUM.format(x="x") + " / size(x), " + _SUM.format(x="transform(x, v -> v * v)") + " / size(x), array_min(x), array_max(x))"),
    "softmax_entropy": Entry("x ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "array(ln(" + _SUM.format(x="transform(x, v -> exp(v - array_max(x)))") + ") - " + _SUM.format(x="transform(x, v -> (v - array_max(x)) * exp(v - array_max(x)))") + " / " + _SUM.format(x="transform(x, v -> exp(v - array_max(x)))") + ")"),
}

# Sources take a table of raw questions and give (item_id, question, gold_answers, group_id).
SOURCES = {
    "aliases": "SELECT item_id, max_by(question, loaded_at) AS question, sort_array(array_distinct(flatten(collect_list(gold_answers)))) AS gold_answers, item_id AS group_id FROM {t} WHERE item_id IS NOT NULL GROUP BY item_id",
    "passages": "SELECT DISTINCT item_id, question, array_sort(array_distinct(gold_answers)) AS gold_answers, CASE WHEN context IS NULL THEN item_id ELSE concat(split_part(item_id, ':', 1), ':', substring(sha1(context), 1, 16)) END AS group_id FROM {t} WHERE item_id IS NOT NULL AND size(gold_answers) > 0",
    "turns": "SELECT DISTINCT item_id, question, gold_answers, meta['conversation'] AS group_id FROM {t} WHERE item_id IS NOT NULL AND meta['conversation'] IS NOT NULL",
}


def install(spark: SparkSession, judges: dict[str, Entry] | None = None, features: dict[str, Entry] | None = None) -> list[str]:
    """Make the entries functions of the session, ``judge_<name>`` and ``feature_<name>``; their names come back.

    A name that is taken is an error, as is one that is no SQL name.
    """
    ours = {**{f"judge_{k}": e for k, e in JUDGES.items()}, **{f"feature_{k}": e for k, e in FEATURES.items()}}
    added = {**{f"judge_{k}": e for k, e in (judges or {}).items()}, **{f"feature_{k}": e for k, e in (features or {}).items()}}
    wrong = [k for k in added if k in ours or not k.replace("_", "").isalnum()]
    if wrong:
        raise ValueError(f"names taken or not fit for SQL: {', '.join(sorted(wrong))}")
    for name, e in {**ours, **added}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({e.takes}) RETURNS {e.gives} RETURN {e.body}")
    return sorted([*ours, *added])


def judged(df: DataFrame, key: str, answer: str, golds: str, names: list[str]) -> DataFrame:
    """(key, judge, label) by every named judge of the session."""
    labels = [F.struct(F.lit(n).alias("judge"), F.call_function(f"judge_{n}", F.col(answer), F.col(golds)).alias("label")) for n in names]
    return df.select(key, F.array(*labels).alias("v")).select(key, F.inline("v"))


def extracted(df: DataFrame, key: str, column: str, names: list[str]) -> DataFrame:
    """(key, block, values) by every named extractor of the session; null and empty arrays are left out."""
    rows = df.select(key, F.transform(column, lambda v: v.cast("double")).alias("x")).filter("size(x) > 0")
    blocks = [F.struct(F.lit(n).alias("block"), F.call_function(f"feature_{n}", F.col("x")).alias("values")) for n in names]
    return rows.select(key, F.array(*blocks).alias("v")).select(key, F.inline("v"))


def loaded(df: DataFrame, name: str) -> DataFrame:
    """The items of a table of raw questions, read by the named source."""
    if name not in SOURCES:
        raise KeyError(f"no source {name!r}; there are {', '.join(SOURCES)}")
    return df.sparkSession.sql(SOURCES[name], t=df)


def select_judges(votes: DataFrame, *parts: str) -> DataFrame:
    """Votes of judges whose name holds one of the parts, whatever the case; all votes without parts."""
    if not parts:
        return votes
    keep = F.lit(False)
    for p in parts:
        keep = keep | F.lower("judge").contains(p.lower())
    return votes.filter(keep)
