"""Problem 8: the reading level of each document.

Features are distributions over a text: lengths of words and sentences, vocabulary (how hard the
words known from graded texts of its language are), syntax (commas and joining words by sentence) and
cohesion (words that a sentence shares with the one before). Gradient-boosted regression trees map
them to the grade's number; cuts between grades are calibrated on held-out predictions, and accuracy is
counted on folds that neither the trees nor the cuts have seen.

The model is fitted on at most MAX_GRADED graded rows, drawn by hash; every document is graded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import LLM
from tallymill.llm.p4_defects import FUNCTION_WORDS
from tallymill.llm.textnorm import WORD, clean
from tallymill.functions.trees import Boosted, fit
from tallymill.sources.tables import table

MAX_GRADED = 20_000
FOLDS = 6
LEAST_WORDS = 30
BAYES_HEAT = 6.0  # words of a text are not independent; their evidence is divided by this
STOP = re.compile(r"[.!?]+[\"'”’»)\]]*(?=\s|$)|;(?=\s+[\"'“‘«(]?[A-ZÀ-Þ])")
LANGUAGES = tuple(FUNCTION_WORDS)
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
# A line that is a label, or a line of fields between bars, is not prose.
FIELDS = re.compile(r"^[^\n|]*\|[^\n]*\|[^\n]*$", re.M)
LABEL = re.compile(r"^\s*(?:>\s*)*[A-Za-z]{1,12}:[ \t]*", re.M)

NAMES = (
    "word_mean", "word_sd", "word_p90", "word_long", "sent_mean", "sent_median", "sent_p90", "sent_sd", "commas", "joins", "ttr", "cohesion",
    "lex_mean", "lex_p90", "lex_p50", "lex_1", "lex_2", "lex_3", "lex_4", "lex_known", "bayes", "bayes_sd", *(f"is_{k}" for k in LANGUAGES),
)


def language(count: dict[str, int], labelled: str | None = None) -> str:
    """The language of a text by its function words; of a text without any, the label's, else English."""
    best = {k: sum([count[w] for w in s if w in count]) for k, s in _SETS.items()}
    top = max(LANGUAGES, key=lambda k: best[k])
    if best[top] < 2:
        code = (labelled or "")[:2].lower()
        return code if code in _SETS else top
    return top


def diversity(words: list[str], width: int = 100) -> float:
    """The share of different words in a run of ``width`` words, as the mean over all runs of the text."""
    n = len(words)
    if n <= width:
        return len(set(words)) / max(1, n)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    # A word is new in the runs that begin after its last occurrence and hold its place.
    at = np.arange(n)
    runs = np.minimum(at, n - width) - np.maximum(before + 1, np.maximum(at - width + 1, 0)) + 1
    return float(np.maximum(runs, 0).sum()) / (width * (n - width + 1))


def prose(text: str) -> str:
    text = clean(text)
    if "|" in text:
        text = FIELDS.sub("", text)
    return LABEL.sub("", text) if ":" in text else text


@dataclass
class Words:
    """A language's words: their rows, and by row the expected grade, the most typical one, log chances by grade."""

    row: dict[str, int]
    expected: np.ndarray
    typical: np.ndarray
    chance: np.ndarray


Lexicon = dict[str, Words]


def lexicon(rows: list[tuple[str, list[str], int]], grades: int) -> Lexicon:
    """From (language, words, grade number from 0); words of a single text are left out."""
    seen: dict[str, dict[str, np.ndarray]] = {}
    texts: dict[str, np.ndarray] = {}
    for lang, words, g in rows:
        texts.setdefault(lang, np.zeros(grades))[g] += 1
        own = seen.setdefault(lang, {})
        for w in set(words):
            own.setdefault(w, np.zeros(grades))[g] += 1
    out: Lexicon = {}
    for lang, own in seen.items():
        kept = sorted(w for w, c in own.items() if c.sum() >= 2)
        c = np.array([own[w] for w in kept]).reshape(len(kept), grades)
        size = np.maximum(texts[lang], 1.0)
        p = c / size + 0.02
        p /= p.sum(axis=1, keepdims=True)
        out[lang] = Words({w: k for k, w in enumerate(kept)}, p @ np.arange(1, grades + 1), p.argmax(axis=1), np.log((c + 0.2) / (size + 1.0)))
    return out


def sentences(text: str) -> list[list[str]]:
    """Words by sentence, case-folded."""
    return [w for p in STOP.split(text) if (w := WORD.findall(p.casefold()))]


def _quantile(ordered: np.ndarray, p: float) -> float:
    at = p * (len(ordered) - 1)
    k = int(at)
    return float(ordered[k] if k + 1 >= len(ordered) else ordered[k] + (at - k) * (ordered[k + 1] - ordered[k]))


def features(text: str, sents: list[list[str]], lang: str, lex: Lexicon, grades: int = 4, words: list[str] | None = None, count: dict[str, int] | None = None) -> list[float]:
    words = [w for s in sents for w in s] if words is None else words
    count = Counter(words) if count is None else count
    n = max(1, len(words))
    size = np.sort(np.fromiter(map(len, words), float, len(words))) if words else np.zeros(1)
    full = [s for s in sents if len(s) > 2] or [words]  # without headings and one-word questions
    length = np.sort(np.array([len(s) for s in full], float))
    joins = sum([count[w] for w in _SETS[lang] if w in count]) / n
    sets = [set(s) for s in full]
    shared = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(sets, sets[1:], strict=False)]
    lex_features = [2.5, 2.5, 2.5, *[0.0] * grades, 0.0, 2.5, 1.0]
    own = lex.get(lang)
    if own is not None:
        at = np.array([k for k in map(own.row.get, words) if k is not None], np.int64)
        if len(at):
            e = np.sort(own.expected[at])
            kind = np.bincount(own.typical[at], minlength=grades)[:grades] / len(at)
            chance = own.chance[np.unique(at)].sum(axis=0)
            chance = np.exp((chance - chance.max()) / BAYES_HEAT)
            chance /= chance.sum()
            by = np.arange(1, len(chance) + 1)
            bayes = float(chance @ by)
            lex_features = [e.mean(), _quantile(e, 0.9), _quantile(e, 0.5), *kind, len(at) / n, bayes, float(np.sqrt(chance @ (by - bayes) ** 2))]
    return [
        size.mean(), size.std(), _quantile(size, 0.9), (size >= 10).mean(),
        length.mean(), _quantile(length, 0.5), _quantile(length, 0.9), length.std(),
        text.count(",") / n, joins, diversity(words), sum(shared) / len(shared) if shared else 0.0,
        *lex_features, *(float(lang == k) for k in LANGUAGES),
    ]


@dataclass
class Grader:
    grades: list[str]
    lex: Lexicon
    model: Boosted
    cuts: np.ndarray
    accuracy: dict[str, tuple[int, int]]

    def grade(self, scores: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, scores)


def _fold(text_id: object) -> int:
    return (int(text_id) * 2654435761 >> 7) % FOLDS


def _cuts(scores: np.ndarray, y: np.ndarray, grades: int) -> np.ndarray:
    """Between two grades, the cut with the fewest held-out errors; of equals the one nearest to the middle."""
    out = []
    for g in range(1, grades):
        near = (y == g) | (y == g + 1)
        s, up = scores[near], y[near] > g
        if not near.any():
            out.append(g + 0.5)
            continue
        at = np.unique(np.concatenate([s, [g + 0.5]]))
        at = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
        wrong = np.array([(up != (s > a)).sum() for a in at])
        good = at[wrong == wrong.min()]
        out.append(g + 0.5 if good[0] <= g + 0.5 <= good[-1] else float(good[np.abs(good - g - 0.5).argmin()]))
    return np.maximum.accumulate(np.array(out))


def train(rows: list[tuple[object, str, str | None, str]]) -> Grader:
    """From (text_id, text, lang, grade). Folds serve for the words' grades, the cuts and the accuracy."""
    grades = sorted({g for _, _, _, g in rows})
    if not grades:
        raise ValueError("there are no graded texts")
    number = {g: k for k, g in enumerate(grades)}
    texts = [prose(t) for _, t, _, _ in rows]
    sents = [sentences(t) for t in texts]
    words = [[w for x in s for w in x] for s in sents]
    langs = [language(Counter(w), lang) for w, (_, _, lang, _) in zip(words, rows, strict=True)]
    # Stops get lost or stand where no sentence ends, so every text also counts as one run of words and
    # as short pieces; both have its grade and its fold.
    forms = [[s, [w], [w[a : a + 6] for a in range(0, len(w), 6)]] for s, w in zip(sents, words, strict=True)]
    y = np.array([number[g] + 1 for _, _, _, g in rows], float)
    fold = np.array([_fold(i) for i, _, _, _ in rows])
    triples = list(zip(langs, words, (y - 1).astype(int).tolist(), strict=True))
    x = np.zeros((3, len(rows), len(NAMES) - 4 + len(grades)))
    for f in range(FOLDS):
        lex = lexicon([t for t, k in zip(triples, fold, strict=True) if k != f], len(grades))
        for k in np.flatnonzero(fold == f):
            for j, form in enumerate(forms[k]):
                x[j, k] = features(texts[k] if j == 0 else "", form, langs[k], lex, len(grades))
    held = np.zeros(len(rows))
    for f in range(FOLDS):
        own = fold == f
        if own.any():
            held[own] = fit(np.concatenate(x[:, ~own]), np.tile(y[~own], 3)).predict(x[0, own]) if (~own).any() else y.mean()
    cuts = _cuts(held, y, len(grades))
    right = np.zeros(len(rows), bool)
    for f in range(FOLDS):  # accuracy: each fold by cuts of the others
        own = fold == f
        if own.any() and (~own).any():
            right[own] = np.searchsorted(_cuts(held[~own], y[~own], len(grades)), held[own]) == y[own] - 1
    accuracy = {k: (int(right[[g == k for g in langs]].sum()), langs.count(k)) for k in LANGUAGES if k in langs}
    return Grader(grades, lexicon(triples, len(grades)), fit(np.concatenate(x), np.tile(y, 3)), cuts, accuracy)


def trained(graded: DataFrame) -> Grader:
    """A grader from (text_id, text, lang, grade); rows without text or grade are left out."""
    rows = graded.select("text_id", "text", "lang", "grade").filter("text_id is not null and text is not null and grade is not null and trim(text) <> ''")
    rows = rows.orderBy(F.xxhash64("text_id"), "text_id", "text").limit(MAX_GRADED)
    return train([tuple(r) for r in sorted(rows.collect(), key=lambda r: (r["text_id"], r["text"]))])


def graded(documents: DataFrame, grader: Grader, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, lang, score, grade) of every document with at least ``least`` words by white space.

    Null and shorter texts, and rows without doc_id, have no grade. The language is read from the
    text; the label serves only for a text without function words. Repeated rows come out as often.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, x = [], [], []
            for i, t, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i is None or not t or len(t.split()) < least:
                    continue
                text = prose(t)
                sents = sentences(text)
                words = [w for s in sents for w in s]
                count = Counter(words)
                lang = language(count, label)
                ids.append(i)
                langs.append(lang)
                x.append(features(text, sents, lang, grader.lex, len(grader.grades), words, count))
            if ids:
                s = grader.model.predict(np.array(x))
                g = [grader.grades[k] for k in grader.grade(s)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(langs), pa.array(s), pa.array(g)], names=["doc_id", "lang", "score", "grade"])

    return documents.select("doc_id", "text", "lang").mapInArrow(run, f"doc_id {kind}, lang string, score double, grade string")


@LLM.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grade of every document of at least 30 words."""
    grader = trained(table(spark, sf_dir, "graded_texts"))
    return graded(table(spark, sf_dir, "documents"), grader).select("doc_id", "grade").distinct()


@LLM.query("p8_accuracy")
def p8_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out accuracy of the grades by language; graded texts have no other source."""
    grader = trained(table(spark, sf_dir, "graded_texts"))
    rows = [(k, a, n, a / n) for k, (a, n) in sorted(grader.accuracy.items())]
    return spark.createDataFrame(rows, "lang string, n_right long, n_texts long, accuracy double")


@LLM.query("p8_profile")
def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and grade."""
    docs = table(spark, sf_dir, "documents")
    found = graded(docs, trained(table(spark, sf_dir, "graded_texts")))
    return found.select("doc_id", "grade").join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "grade").agg(F.count(F.lit(1)).alias("n_documents"))
