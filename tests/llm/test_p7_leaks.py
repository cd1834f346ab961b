import random

from tallymill.llm import p7_leaks as m
from tallymill.llm.textnorm import clean, plain_words

WORDS = [f"w{k}" for k in range(400)]


def longest_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def longest_chain(text, p, gap=m.GAP):
    """Brute force over all pairs of matched places."""
    best, at = 0, {}
    for d, t in enumerate(text):
        for i, w in enumerate(p):
            if t == w:
                n = 1 + max([at[e, k] for e in range(max(0, d - gap - 1), d) for k in range(max(0, i - gap - 1), i) if (e, k) in at], default=0)
                at[d, i] = n
                best = max(best, n)
    return best


def corpus(rng):
    passages = [[rng.choice(WORDS) for _ in range(rng.randint(20, 60))] for _ in range(8)]
    docs = []
    for k in range(160):
        d = [rng.choice(WORDS) for _ in range(rng.randint(0, 120))]
        p = rng.choice(passages)
        kind = k % 8
        if kind == 1:
            a = rng.randint(0, len(p) - 16)
            d[10:10] = p[a : a + 16]
        elif kind == 2:
            a = rng.randint(0, len(p) - 15)
            d[10:10] = p[a : a + 15]
        elif kind == 3:
            d[5:5] = [w if rng.random() > 0.25 else rng.choice(WORDS) for w in p]
        elif kind == 4:
            d[5:5] = [w for w in p if rng.random() > 0.2]
        elif kind == 5:
            d[5:5] = [x for w in p for x in ([w] if rng.random() > 0.3 else [w, rng.choice(WORDS)])]
        elif kind == 6:
            d[5:5] = rng.sample(p, len(p))
        elif kind == 7:
            d = list(p)
        docs.append(d)
    return passages, docs


def brute(passages, docs):
    return {(k, e) for k, d in enumerate(docs) for e, p in enumerate(passages) if longest_run(d, p) >= 16 or longest_chain(d, p) >= 0.6 * len(p) - 1e-9}


def test_against_brute_force(spark, extra, monkeypatch):
    passages, docs = corpus(random.Random(5))
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string").repartition(3)
    ev = spark.createDataFrame([(e, " ".join(p)) for e, p in enumerate(passages)], "eval_id long, passage string")
    want = brute(passages, docs)
    assert 60 < len(want) < 130
    got = [tuple(r) for r in m.leaks(extra(df), extra(ev)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_small_shards_change_nothing():
    passages, docs = corpus(random.Random(6))
    import pyarrow as pa

    p = m.Passages(list(enumerate(passages)))
    known = pa.array(list(p.terms))
    one = m.index_row(docs)
    hits = {(d, p.ids[k]) for d, k in m.search(m.Shard(one[0], pa.array(one[1]), one[2], one[3], known), p)}
    assert hits == brute(passages, docs)


def test_written_form_does_not_count(spark):
    text = "The crowded gardener got Ravanholm in 1724 while Ithibrin repaired this legislation in the middle of the naïve storm beside the straße"
    forms = [text.upper(), text.replace(" ", "\n"), f"<p>{text.replace(' ', '&nbsp;')}</p>", text.replace("gardener", "gar-\ndener").replace("repaired", "re<b></b>paired"), text.replace("a", "а"), text.replace("o", "o​"), "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in text), text.encode().decode("latin-1"), text.replace(" in", " [4] in"), text.replace(" ", ", ")]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(forms)] + [(99, "something else entirely"), (100, None), (101, ""), (None, text), (102, "long " * 200000 + text)], "doc_id long, text string")
    ev = spark.createDataFrame([(7, text), (8, text), (9, None), (10, ""), (None, text)], "eval_id long, passage string")
    got = {tuple(r) for r in m.leaks(df, ev).collect()}
    assert got == {(k, e) for k in [*range(len(forms)), 102] for e in (7, 8)}


def test_empty_tables(spark):
    d, e = "doc_id long, text string", "eval_id long, passage string"
    row = spark.createDataFrame([(1, "a b c")], d)
    assert m.leaks(spark.createDataFrame([], d), spark.createDataFrame([(1, "a b c")], e)).collect() == []
    assert m.leaks(row, spark.createDataFrame([], e)).collect() == []


def test_clean():
    assert clean("cafÃ© a<br>b &amp; c") == "café a\nb & c"
    assert plain_words("Ｆｕｌｌ ﬁt x²") == ["full", "fit", "x2"]


def test_passages_are_searched_in_parts(spark, monkeypatch):
    passages, docs = corpus(random.Random(7))
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    ev = spark.createDataFrame([(e, " ".join(p)) for e, p in enumerate(passages)], "eval_id long, passage string")
    monkeypatch.setattr(m, "PART", 300)
    got = [tuple(r) for r in m.leaks(df, ev).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(passages, docs)


def test_short_passages():
    import pyarrow as pa

    rng = random.Random(8)
    few = [f"v{k}" for k in range(12)]
    docs = [[rng.choice(few) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    passages = [[rng.choice(few) for _ in range(n)] for n in range(1, 13)]
    p = m.Passages(list(enumerate(passages)))
    row = m.index_row(docs)
    hits = {(d, p.ids[k]) for d, k in m.search(m.Shard(row[0], pa.array(row[1]), row[2], row[3], pa.array(list(p.terms))), p)}
    assert hits == brute(passages, docs)


def test_tags_of_any_length():
    assert plain_words("one <a href='" + "x y " * 400 + "'>two</a> three") == ["one", "two", "three"]
