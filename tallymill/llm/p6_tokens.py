"""Problem 6: the whole corpus as ids of a public byte-pair tokenizer.

Every Arrow batch is one unit of work and needs no shuffle. Its texts are cut into words by the
tokenizer's pattern; the distinct words that this worker has not met are contracted by one recursive
DuckDB query over (word, position, token) rows; an ordered aggregate turns the last rows of each word
into its id list; the texts are put together from the lists of their words.

Null and empty texts have the empty list. Texts that hold the string of a special token are ordinary
text. Invalid surrogates cannot occur, as Parquet strings are UTF-8.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallymill.llm import LLM
from tallymill.session import env_path
from tallymill.sources.tables import table

TOKENIZERS = env_path("TALLYMILL_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the published word pattern of the byte-level tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KEPT_WORDS = 400_000  # words remembered by a worker; beyond it the memory starts anew
KEPT_BYTES = 64  # longer words are contracted wherever they occur and not remembered
ROUND_BYTES = 1_000_000  # bytes of new words contracted by one query

# All occurrences of a word's minimum-rank pair are contracted in one step, leftmost first. That is
# what contracting them one by one gives: a pair made by a merge has a higher rank than the merge.
CONTRACT = """
with recursive step(n, w, pos, tok) as (
    select 0, w, pos, tok from bytes_of_words
  union all
    select n + 1, w, pos, tok from (
        select n, w, pos, case when taken then made else tok end as tok,
               coalesce(lag(taken) over (partition by w order by pos), false) as eaten
        from (
            select n, w, pos, tok, made,
                   hit and row_number() over (partition by w, hit, run order by pos) % 2 = 1 as taken
            from (
                select *, row_number() over (partition by w order by pos)
                          - row_number() over (partition by w, hit order by pos) as run
                from (
                    select n, w, pos, tok, made, least_rank, coalesce(rank = least_rank, false) as hit
                    from (
                        select p.n, p.w, p.pos, p.tok, m.rank, m.made,
                               min(m.rank) over (partition by p.w) as least_rank
                        from (select *, lead(tok) over (partition by w order by pos) as after from step) p
                        left join merges m on m.l = p.tok and m.r = p.after)
                    where least_rank is not null)))
    ) where not eaten
)
select w, list(tok order by pos) as ids
from (select *, max(n) over (partition by w) as last from step) where n = last
group by w order by w
"""


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte, as byte-level vocabularies write it."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, pa.Table]:
    """The id of each byte, and the merge table (l, r, rank, made)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, letters = model["vocab"], byte_letters()
    of_byte = np.zeros(256, np.int32)
    for letter, b in letters.items():
        of_byte[b] = ids[letter]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    cols = [[ids[a] for a, _ in pairs], [ids[b] for _, b in pairs], list(range(len(pairs))), [ids[a + b] for a, b in pairs]]
    return of_byte, pa.table([pa.array(c, pa.int32()) for c in cols], names=["l", "r", "rank", "made"])


class Encoder:
    """Word lists to id lists by DuckDB, with a memory of the words met."""

    def __init__(self, path: str) -> None:
        import duckdb
        import regex

        self.find = regex.compile(WORDS).findall
        self.of_byte, merges = vocabulary(path)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "preserve_insertion_order": "false"})
        self.db.execute("set temp_directory = ''")  # nothing is spilled to a worker's own disk
        self.db.register("given", merges)
        self.db.execute("create table merges as select * from given")
        self.db.unregister("given")
        self.known: dict[str, np.ndarray] = {}

    def contract(self, words: list[str]) -> list[np.ndarray]:
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        total = int(sizes.sum())
        rows = pa.table(
            [
                pa.array(np.repeat(np.arange(len(raw), dtype=np.int32), sizes)),
                pa.array((np.arange(total) - start).astype(np.int32)),
                pa.array(self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]),
            ],
            names=["w", "pos", "tok"],
        )
        self.db.register("bytes_of_words", rows)
        out = self.db.sql(CONTRACT).to_arrow_table()
        self.db.unregister("bytes_of_words")
        lists = out.column("ids").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.int32)
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def learn(self, words: list[str]) -> dict[str, np.ndarray]:
        """Ids of words not met before; a query takes a bounded number of bytes (or one longer word)."""
        found: dict[str, np.ndarray] = {}
        group: list[str] = []
        size = 0
        for w in words:
            if group and size + len(w) > ROUND_BYTES:
                found.update(zip(group, self.contract(group), strict=True))
                group, size = [], 0
            group.append(w)
            size += len(w)
        if group:
            found.update(zip(group, self.contract(group), strict=True))
        return found

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        cut = [self.find(t) if t else [] for t in texts]
        fresh: dict[str, None] = {}
        for words in cut:
            for w in words:
                if w not in self.known:
                    fresh[w] = None
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known = {}
            fresh = dict.fromkeys(w for words in cut for w in words)
        now = self.learn(list(fresh)) if fresh else {}
        self.known.update((w, i) for w, i in now.items() if len(w) <= KEPT_BYTES)
        get, parts, sizes = self.known.get, [], np.zeros(len(cut), np.int64)
        for k, words in enumerate(cut):
            own = [x if (x := get(w)) is not None else now[w] for w in words]
            sizes[k] = sum(map(len, own))
            parts.extend(own)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, rows: int = 1000) -> DataFrame:
    """(id, ids) of each row of ``df``; other columns are dropped, so their names cannot clash.

    ``rows`` texts are worked on at a time; a text is never cut, however long it is. Repeated rows
    and null ids come out as they are; an empty table gives an empty table.
    """
    where = path or os.path.join(TOKENIZERS, "byte_bpe_50k.json")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), enc.encode(part.column(1).to_pylist())], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


@LLM.query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids of every document, by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"))
