"""Problem 7: evaluation texts leaking into training text.

The training text becomes a positional inverted index that is distributed by document and stored in
the shared folder: a row is a shard of documents with its terms and, for every term, the sorted
positions at which it stands (its postings). Making it needs no shuffle, and searching it reads whole
shards where they lie; of a shard, only the postings of the passages' terms are looked at. Only the
test passages go to every task, in parts of bounded size, a search for each part.

Exact matches: a run of 16 words holds a whole block of eight that starts at a multiple of eight. Blocks
whose terms all occur in the shard are looked up by intersecting their terms' postings, each adjusted
by its term's offset, from the rarest term on. The places left are grown to runs.

Proximity matches: of the half of a passage's positions that are rarest in the shard, a text with three
fifths of its words in order must hold a tenth of the passage's words. Their postings, adjusted by the
offset, are counted in overlapping bands; bands with enough different positions are aligned word by
word, with at most GAP words changed, added or dropped between two matched ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import LLM
from tallymill.llm.textnorm import plain_words
from tallymill.session import cut
from tallymill.sources.tables import table

RUN, BLOCK = 16, 8
SHARE = 0.6
GAP = 2
SHARD_WORDS = 500_000
PART = 120_000_000  # characters of passages that are sent to every task at once


class Passages:
    """The passages as arrays of term numbers."""

    def __init__(self, rows: list[tuple[int, list[str]]]) -> None:
        self.terms: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        for i, words in rows:
            if words:
                self.ids.append(i)
                self.words.append(np.array([self.terms.setdefault(w, len(self.terms)) for w in words], np.int32))
        self.all = np.concatenate(self.words) if self.words else np.zeros(0, np.int32)
        self.first = np.cumsum([0, *[len(w) for w in self.words]])
        # The blocks of all passages: which passage, where it begins, its terms.
        at = [(k, s) for k, w in enumerate(self.words) for s in range(0, len(w) - BLOCK + 1, BLOCK)]
        self.of, self.start = (np.array([x[j] for x in at], np.int64) for j in (0, 1))
        self.blocks = self.all[(self.first[self.of] + self.start)[:, None] + np.arange(BLOCK)] if at else np.zeros((0, BLOCK), np.int32)


INDEX = "doc_ids array<{kind}>, starts binary, terms array<string>, bounds binary, positions binary"


def index_row(docs: list[list[str]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """starts, terms, bounds, positions of a shard. A position between two documents stays free."""
    number: dict[str, int] = {}
    flat: list[int] = []
    starts = [0]
    for words in docs:
        flat.extend(number.setdefault(w, len(number)) for w in words)
        flat.append(-1)
        starts.append(len(flat))
    t = np.array(flat, np.int32)
    order = np.argsort(t, kind="stable").astype(np.int32)
    bounds = np.searchsorted(t[order], np.arange(len(number) + 1)).astype(np.int32)
    return np.array(starts, np.int32), list(number), bounds, order


class Shard:
    """A shard's postings of the passages' terms; -1 is any other word, -2 ends a document."""

    def __init__(self, starts: np.ndarray, terms: pa.Array, bounds: np.ndarray, positions: np.ndarray, known: pa.Array) -> None:
        of = pc.index_in(terms, value_set=known)  # the passages' number of each of the shard's terms
        mine = np.flatnonzero(of.is_valid().to_numpy(zero_copy_only=False))
        number = of.take(pa.array(mine)).to_numpy(zero_copy_only=False).astype(np.int64)
        mine, number = mine[np.argsort(number)], np.sort(number)
        size = np.zeros(len(known), np.int64)
        size[number] = bounds[mine + 1] - bounds[mine]
        self.starts, self.counts = starts, size
        self.bounds = np.concatenate([[0], np.cumsum(size)])
        self.order = np.concatenate([positions[bounds[k] : bounds[k + 1]] for k in mine]) if len(mine) else np.zeros(0, np.int32)
        self.flat = np.full(int(starts[-1]) + BLOCK + 1, -1, np.int32)
        self.flat[self.order] = np.repeat(np.arange(len(known)), size)
        self.flat[starts[1:] - 1] = -2
        self.flat[int(starts[-1]) :] = -2

    def postings(self, term: int) -> np.ndarray:
        return self.order[self.bounds[term] : self.bounds[term + 1]]

    def doc(self, at: np.ndarray | int) -> np.ndarray | int:
        return np.searchsorted(self.starts, at, side="right") - 1


def _among(postings: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places are in the (sorted) postings."""
    k = np.minimum(np.searchsorted(postings, at), len(postings) - 1)
    return postings[k] == at


def _exact(shard: Shard, passages: Passages, least: int) -> list[set[int]]:
    """For each passage, the documents with ``least`` of its words in a row."""
    found: list[set[int]] = [set() for _ in passages.words]
    flat = shard.flat
    for k in np.flatnonzero((shard.counts[passages.blocks] > 0).all(axis=1)):
        block, p, s = passages.blocks[k], passages.words[passages.of[k]], int(passages.start[k])
        own = found[passages.of[k]]
        by_count = np.argsort(shard.counts[block], kind="stable")
        at = shard.postings(int(block[by_count[0]])) - int(by_count[0])
        for o in by_count[1:]:
            at = at[_among(shard.postings(int(block[o])), at + o)]
            if not len(at):
                break
        for a in at:
            d = int(shard.doc(int(a)))
            if d in own:
                continue
            lo, hi = int(a), int(a) + BLOCK
            i, j = s, s + BLOCK
            while i > 0 and lo > 0 and flat[lo - 1] == p[i - 1]:
                lo, i = lo - 1, i - 1
            while j < len(p) and flat[hi] == p[j]:
                hi, j = hi + 1, j + 1
            if hi - lo >= least:
                own.add(d)
    return found


def aligned(text: np.ndarray, p: np.ndarray, gap: int = GAP) -> int:
    """Most passage words found in order in one stretch, with at most ``gap`` others between two."""
    where: dict[int, list[int]] = {}
    for i, t in enumerate(p.tolist()):
        where.setdefault(t, []).append(i)
    reach = gap + 1
    best: list[dict[int, int]] = []  # of the last ``reach`` text positions: passage position to length
    most = 0
    for t in text.tolist():
        now: dict[int, int] = {}
        for i in where.get(t, ()):
            length = 1
            for back in best:
                for k in range(max(0, i - reach), i):
                    if k in back and back[k] >= length:
                        length = back[k] + 1
            now[i] = length
            most = max(most, length)
        best.append(now)
        if len(best) > reach:
            best.pop(0)
    return most


def has(terms: np.ndarray, p: np.ndarray) -> int:
    """How many of the passage's places have their word among the (sorted) terms."""
    at = np.minimum(np.searchsorted(terms, p), len(terms) - 1)
    return int((terms[at] == p).sum())


def _near(shard: Shard, p: np.ndarray, known: set[int], share: float) -> set[int]:
    """Documents with ``share`` of the passage's words in order in one stretch."""
    n = len(p)
    rare = np.argsort(shard.counts[p], kind="stable")[: (n + 1) // 2]
    need = max(1, int(np.ceil(len(rare) - (1.0 - share) * n - 1e-9)))
    lists = [shard.postings(int(p[i])) for i in rare]
    size = np.array([len(x) for x in lists])
    if not size.sum():
        return set()
    at = np.concatenate(lists).astype(np.int64)
    of = np.repeat(rare, size).astype(np.int64)
    width = n
    band = (at - of + width) // width
    # Raw votes first (a count); only bands that have enough are looked at for different positions.
    raw = np.bincount(band, minlength=int(band.max()) + 2)
    raw[1:] += raw[:-1].copy()
    enough = np.flatnonzero(raw >= need)
    if not len(enough):
        return set()
    near = np.zeros(len(raw) + 1, bool)
    near[enough] = True
    kept = near[band] | near[band + 1]
    band, of = band[kept], of[kept]
    key = np.concatenate([band, band + 1]) * (n + 1) + np.concatenate([of, of])
    bands, votes = np.unique(np.unique(key) // (n + 1), return_counts=True)
    found: set[int] = set()
    least = int(np.ceil(share * n - 1e-9))
    for b in bands[votes >= need]:
        lo, hi = int((b - 2) * width), int((b + 1) * width + 2 * n)
        first, last = int(shard.doc(max(lo, 0))), int(shard.doc(min(hi, len(shard.flat) - 1)))
        for d in range(max(first, 0), min(last, len(shard.starts) - 2) + 1):
            if d in found or d in known:
                continue
            text = shard.flat[max(lo, shard.starts[d]) : min(hi, shard.starts[d + 1] - 1)]
            if len(text) < least:
                continue
            here = np.unique(text)
            # Enough of the passage's places, and of its rare ones, must have their word in this text.
            if has(here, p) >= least and has(here, p[rare]) >= need and aligned(text, p) >= least:
                found.add(d)
    return found


def search(shard: Shard, passages: Passages, least: int = RUN, share: float = SHARE) -> list[tuple[int, int]]:
    """(number of the document, number of the passage) of all matches in one shard."""
    if not passages.words:
        return []
    exact = _exact(shard, passages, least)
    # Enough of a passage's places must have their word anywhere in the shard.
    present = np.add.reduceat(shard.counts[passages.all] > 0, passages.first[:-1], dtype=np.int64)
    for k in np.flatnonzero(present >= np.ceil(share * np.diff(passages.first) - 1e-9)):
        exact[k] |= _near(shard, passages.words[k], exact[k], share)
    return [(d, k) for k, own in enumerate(exact) for d in own]


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of (doc_id, text), a row per shard. Null and empty texts and null ids are left out.

    A shard has at most SHARD_WORDS words; a longer text is a shard of its own and is indexed whole.
    """
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        docs: list[list[str]] = []
        size, of = 0, None

        def flush() -> pa.RecordBatch:
            starts, terms, bounds, positions = index_row(docs)
            cols = [pa.array([ids], pa.list_(of)), pa.array([starts.tobytes()]), pa.array([terms], pa.list_(pa.string())), pa.array([bounds.tobytes()]), pa.array([positions.tobytes()])]
            return pa.RecordBatch.from_arrays(cols, names=["doc_ids", "starts", "terms", "bounds", "positions"])

        for batch in batches:
            of = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = plain_words(t) if t else []
                if i is None or not words:
                    continue
                if docs and size + len(words) > SHARD_WORDS:
                    yield flush()
                    ids, docs, size = [], [], 0
                ids.append(i)
                docs.append(words)
                size += len(words)
        if docs:
            yield flush()

    return documents.select(doc_id, text).mapInArrow(run, INDEX.format(kind=kind))


def search_index(index: DataFrame, tests: DataFrame, test_id: str = "eval_id", passage: str = "passage", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, eval_id) of every document of the index that holds a passage or enough of it; distinct.

    Null and empty passages match nothing; null ids are left out; equal passages are found under each
    of their ids. Of a passage of one or two words, all have to stand in the text, as three fifths of
    them are one and two.
    """
    rows = tests.select(test_id, passage).filter(F.col(test_id).isNotNull() & F.col(passage).isNotNull())
    rows = rows.distinct().withColumn("part", F.lit(0))
    size = rows.agg(F.coalesce(F.sum(F.length(passage)), F.lit(0))).first()[0]
    parts = 1 + size // PART
    if parts > 1:
        rows = rows.withColumn("part", F.pmod(F.xxhash64(test_id), F.lit(parts)))
    out: DataFrame | None = None
    for k in range(parts):
        passages = Passages([(r[0], plain_words(r[1])) for r in rows.filter(F.col("part") == k).select(test_id, passage).collect()])
        own = _search_part(index, passages, tests.schema[test_id].dataType.simpleString(), test_id, doc_id)
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def _search_part(index: DataFrame, passages: Passages, test_kind: str, test_id: str, doc_id: str) -> DataFrame:
    known = pa.array(list(passages.terms), pa.string())
    doc_kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    to_test = pa.string() if test_kind == "string" else pa.int64() if test_kind == "bigint" else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                starts, bounds, positions = (np.frombuffer(batch.column(c)[k].as_py(), np.int32) for c in (1, 3, 4))
                hits = search(Shard(starts, batch.column(2)[k].values, bounds, positions, known), passages) if len(known) else []
                ids = batch.column(0)[k].values
                a = ids.take(pa.array([d for d, _ in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([a, pa.array([passages.ids[p] for _, p in hits], to_test)], names=[doc_id, test_id])

    return index.mapInArrow(run, f"`{doc_id}` {doc_kind}, `{test_id}` {test_kind}")


def leaks(documents: DataFrame, tests: DataFrame) -> DataFrame:
    """Index the documents, store the index, search it."""
    return search_index(cut(build_index(documents), "postings"), tests)


@LLM.query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry an evaluation passage, in full or in part."""
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "eval_id", "passage"))


@LLM.query("p7_items")
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items that leaked, with the number of documents that carry them."""
    return p7_found(spark, sf_dir).groupBy("eval_id").agg(F.count(F.lit(1)).alias("n_documents"))
