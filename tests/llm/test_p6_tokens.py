import pytest

from tallymill.llm import p6_tokens as m

tokenizers = pytest.importorskip("tokenizers")
TEXTS = ["Hello world's  best\n\n  tabs\t end ", "a" * 9000, "ab" * 3000 + "b", "é" * 300, "<|endoftext|> ok", "aaabaaab" * 200, "日本語 한국어 عربي ไทย", "👩🏽‍🔬 🧭", "x", " ", "\n", "THEY'VE don’t we'll", "1234567890", "", None]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{m.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_exact(spark, reference, extra):
    df = extra(spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "null id")], "doc_id long, text string"))
    rows = m.encode(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r["ids"] == reference("null id" if r["doc_id"] is None else TEXTS[r["doc_id"]])


def test_whole_small_table_and_round_trip(spark, small, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    t = tokenizers.Tokenizer.from_file(f"{m.TOKENIZERS}/byte_bpe_50k.json")
    rows = m.p6_ids(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == reference(texts[r["doc_id"]])
        assert t.decode(r["ids"], skip_special_tokens=False) == (texts[r["doc_id"]] or "")


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(m, "KEPT_WORDS", 3)
    e = m.Encoder(f"{m.TOKENIZERS}/byte_bpe_50k.json")
    a = e.encode(["one two three four five", "six one"]).to_pylist()
    assert a == [m.Encoder(f"{m.TOKENIZERS}/byte_bpe_50k.json").encode([t]).to_pylist()[0] for t in ("one two three four five", "six one")]


def test_empty_table(spark):
    assert m.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
